"""Fetched responses as a source.

Fetching is input and output, not query processing: whatever fetches pages
leaves rows of url, html and, if known, status, content type and duration. A
table of such rows is the default source; a Python data source can be registered
for live fetching.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gossamer.config import EngineConfig
from gossamer.functions import html as H
from gossamer.functions import text as T
from gossamer.functions import url as U


def responses(pages: DataFrame) -> DataFrame:
    """Pages with all columns of a response, defaults where the table has none."""
    have = set(pages.columns)
    default = {
        "final_url": F.col("url"), "status_code": F.lit(200), "content_type": F.lit("text/html"), "fetch_seconds": F.lit(0.0),
        "crawled_at": F.lit(None).cast("timestamp"), "error": F.lit(""), "rendered_title": F.lit(""), "depth": F.lit(0), "render_mode": F.when(U.requires_js("url"), "dynamic").otherwise("static"),
    }
    return pages.select("*", *(c.alias(n) for n, c in default.items() if n not in have))


def guarded(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The error of responses that are not parsed: a content type other than HTML, or a body that is too large."""
    html_type = F.lower("content_type").contains("text/html") | F.lower("content_type").contains("application/xhtml")
    error = F.when(F.col("error") != "", F.col("error")).when(~html_type, F.concat(F.lit("unsupported content type: "), F.col("content_type"))).when(F.octet_length("html") > config.max_body_bytes, "body too large").otherwise("")
    return rows.withColumn("error", error).withColumn("content_length", F.octet_length("html"))


def parsed(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Crawl results: one parse per page, fingerprints, and empty fields where a guard stopped the page.

    The title that a browser reports for a rendered page comes before the parsed one.
    """
    ok = F.col("error") == ""
    body = F.when(ok, F.col("html")).otherwise("")
    out = guarded(responses(rows), config).withColumn("__p", H.parse_html(body, F.col("final_url")))
    empty = F.array().cast("array<string>")
    return out.select(
        "*", F.coalesce(F.nullif(F.trim("rendered_title"), F.lit("")), F.col("__p.title")).alias("title"), F.col("__p.content").alias("content"), F.col("__p.metadata").alias("metadata"),
        F.coalesce(F.col("__p.metadata")["description"], F.lit("")).alias("meta_description"), F.when(ok, F.col("__p.links")).otherwise(empty).alias("links"),
        F.when(ok, T.content_hash("html")).otherwise("").alias("content_hash"),
    ).withColumn("links_count", F.size("links")).withColumn("simhash", F.when(ok, T.simhash("content")).otherwise(F.lit(0).cast("long"))).withColumn("domain", U.extract_host("final_url")).drop("__p")


def render_route(url: Column | str, has_dynamic: bool = True) -> Column:
    """Which fetcher serves a URL; without a dynamic one all are static."""
    return F.when(U.requires_js(url) & F.lit(has_dynamic), "dynamic").otherwise("static")


class HttpPages(DataSource):
    """``spark.read.format("gossamer_http").option("urls", "u1 u2").load()``: plain GETs on the executors."""

    @classmethod
    def name(cls) -> str:
        return "gossamer_http"

    def schema(self) -> str:
        return "url string, final_url string, html string, status_code int, content_type string, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return _HttpReader(self.options)


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = options.get("urls", "").split()
        self.agent = options.get("useragent", "gossamer")
        self.timeout = float(options.get("timeout", "30"))
        self.most = int(options.get("maxbody", str(10 * 1024 * 1024)))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(0, len(self.urls), 50)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in self.urls[partition.value : partition.value + 50]:
            try:
                with urlopen(Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as r:
                    yield url, r.geturl(), r.read(self.most + 1).decode("utf-8", "replace"), r.status, r.headers.get("Content-Type", ""), ""
            except Exception as e:  # whatever went wrong with one page is that page's error
                yield url, url, "", getattr(e, "code", 0), "", str(e) or type(e).__name__


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpPages)
