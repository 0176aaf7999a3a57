"""Extension points: URL filters, extractors and output handlers.

A filter is a function of Columns, so it stays inside the plan; an extractor adds
columns to the pages it matches; a handler takes a finished batch, which makes it
a ``foreachBatch`` sink as well. A table function turns a page into many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from gossamer.functions import html as H

UrlFilter = Callable[[Column], Column]
Handler = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Extractor:
    """``extract`` makes a column from a page's html and url where ``match`` holds; NULL elsewhere."""

    name: str
    match: Callable[[Column], Column]
    extract: Callable[[Column, Column], Column]


@dataclass
class Plugins:
    filters: dict[str, UrlFilter] = field(default_factory=dict)
    extractors: list[Extractor] = field(default_factory=list)
    handlers: dict[str, Handler] = field(default_factory=dict)

    def should_crawl(self, url: Column) -> Column:
        """Whether every filter lets the URL pass."""
        return reduce(lambda a, b: a & b, (f(url) for f in self.filters.values()), F.lit(True))

    def filtered(self, urls: DataFrame, column: str = "normalized") -> DataFrame:
        return urls.where(self.should_crawl(F.col(column)))

    def extracted(self, pages: DataFrame) -> DataFrame:
        return pages.select("*", *(F.when(e.match(F.col("url")), e.extract(F.col("html"), F.col("url"))).alias(e.name) for e in self.extractors))

    def handle(self, batch: DataFrame, epoch: int = 0) -> None:
        """Run all handlers on one batch, computed once."""
        batch.persist()
        try:
            for handler in self.handlers.values():
                handler(batch, epoch)
        finally:
            batch.unpersist()


def register_page_links(spark: SparkSession, name: str = "page_links") -> None:
    """SQL: ``SELECT p.url, l.* FROM pages p, LATERAL page_links(p.html, p.url) l``."""

    @udtf(returnType="position int, link string")
    class PageLinks:
        def eval(self, html: str, url: str) -> Iterator[tuple[int, str]]:
            yield from enumerate(H.links_of(H.build(html or ""), url or ""))

    spark.udtf.register(name, PageLinks)
