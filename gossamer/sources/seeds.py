"""Seeds: a single URL, a text file, or a list; each with a report of what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions import url as U


def seed_urls(spark: SparkSession, urls: list[str], priority: int = 0, depth: int = 0, metadata: dict[str, str] | None = None) -> DataFrame:
    """Raw seeds in arrival order: seq, raw, priority, depth, source_url, metadata."""
    rows = [(i, u, priority, depth, "", metadata or {}) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "seq long, raw string, priority int, depth int, source_url string, metadata map<string,string>")


def seed_file(spark: SparkSession, path: str, priority: int = 0, depth: int = 0) -> DataFrame:
    """Lines of a text file, without white space around them; blank lines and those that start with # are skipped."""
    lines = spark.read.text(path).select(U.trimmed(F.col("value")).alias("raw"), F.monotonically_increasing_id().alias("seq"))
    return lines.where((F.col("raw") != "") & ~F.col("raw").startswith("#")).select("seq", "raw", F.lit(priority).alias("priority"), F.lit(depth).alias("depth"), F.lit("").alias("source_url"), F.create_map().cast("map<string,string>").alias("metadata"))


def judged(seeds: DataFrame) -> DataFrame:
    """Seeds with normalized, host, url_hash and error (NULL where valid)."""
    parts = U.url_struct("raw")
    return seeds.withColumn("__u", parts).select("*", F.col("__u.normalized").alias("normalized"), F.col("__u.host").alias("host"), F.col("__u.error").alias("error"), U.url_hash("__u.normalized").alias("url_hash")).drop("__u")


def seed_status(seeds: DataFrame, seen: DataFrame) -> DataFrame:
    """Each seed with its status: ``invalid``, ``exists`` (seen before or earlier in the batch) or ``added``."""
    rows = judged(seeds)
    first = rows.where(F.col("url_hash").isNotNull()).groupBy("url_hash").agg(F.min("seq").alias("first_seq"))
    known = seen.select("url_hash").distinct().withColumn("known", F.lit(True))
    out = rows.join(first, "url_hash", "left").join(known, "url_hash", "left")
    status = F.when(F.col("normalized").isNull(), "invalid").when(F.col("known") | (F.col("seq") > F.col("first_seq")), "exists").otherwise("added")
    return out.withColumn("status", status).drop("first_seq", "known")


def seed_report(status: DataFrame) -> DataFrame:
    """One row: submitted, added, skipped (valid but known) and invalid; ``seed_errors`` has the invalid ones."""
    n = lambda s: F.count_if(F.col("status") == s)
    return status.agg(F.count("*").alias("submitted"), n("added").alias("added"), n("exists").alias("skipped"), n("invalid").alias("invalid"))


def seed_errors(status: DataFrame) -> DataFrame:
    """(seq, message) of every invalid seed: what was submitted, and why it was not taken."""
    return status.where(F.col("status") == "invalid").select("seq", F.concat(F.col("raw"), F.lit(": "), F.col("error")).alias("message"))
