"""gossamer: crawl-data processing on Spark DataFrames, SQL expressions and Structured Streaming."""

__version__ = "0.1.0"
