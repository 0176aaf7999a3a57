"""Ranked full-text search over parsed pages: a postings table, BM25 and snippets, all as DataFrames.

Contract: BM25 with k1 = 1.2 and b = 0.75 and global statistics; a page's score
is its best field's, boosted; terms are alternatives; order is score descending,
then url; the total is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions.expr import let, struct

K1, B = 1.2, 0.75
# The fields searched with their boosts, and the analyzer's stop words.
FIELDS = {"title": 2.0, "content": 1.0, "meta_description": 1.0}
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
_UNSTOPPED = frozenset(("meta_description",))
FRAGMENT = 150


def analyze(text: Column, stop: bool = True) -> Column:
    """Lower-case runs of letters and digits, without stop words where the field's analyzer drops them."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+", -1), lambda t: t != "")
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS)) if stop else tokens


def _runs(tokens: Column) -> Column:
    """(term, tf) of the distinct tokens, counted within the row: runs of equal ones after a sort."""

    def of_sorted(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda x, j: struct(term=F.get(s, x), tf=(F.coalesce(F.get(at, j + 1), F.size(s)) - x).cast("long"))))

    return let(F.sort_array(tokens), of_sorted)


def _counted(pages: DataFrame, fields: dict[str, float], key: str) -> DataFrame:
    """Postings in the partitions of their pages, without a shuffle; ``first`` marks one of each page and field."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), analyze(F.col(f), f not in _UNSTOPPED).alias("tokens")) for f in fields))
    rows = pages.select(F.col(key), F.explode(parts).alias("x")).select(key, "x.field", F.size("x.tokens").alias("length"), F.posexplode(_runs(F.col("x.tokens"))).alias("i", "run"))
    return rows.select("field", "run.term", key, "run.tf", "length", (F.col("i") == 0).alias("first"))


def postings(pages: DataFrame, fields: dict[str, float] = FIELDS, key: str = "url") -> DataFrame:
    """(field, term, key, tf, length): one row per field, term and page. Written once, it serves any number of queries."""
    return _counted(pages, fields, key).drop("first")


def field_stats(pages: DataFrame, fields: dict[str, float] = FIELDS) -> DataFrame:
    """(field, docs, mean_length) over pages whose field has a term; one row per field."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.size(analyze(F.col(f), f not in _UNSTOPPED)).alias("n")) for f in fields))
    rows = pages.select(F.explode(parts).alias("x")).where(F.col("x.n") > 0)
    return rows.groupBy("x.field").agg(F.count("*").alias("docs"), F.avg("x.n").alias("mean_length"))


def _hit(field: str, term: str) -> Column:
    tokens = F.col(f"__{field}")
    return F.struct(F.lit(field).alias("field"), F.lit(term).alias("term"), F.size(F.filter(tokens, lambda x: x == term)).alias("tf"), F.size(tokens).alias("length"))


def matching_counts(pages: DataFrame, terms: list[str], fields: dict[str, float] = FIELDS, key: str = "url") -> DataFrame:
    """Like ``postings`` for the query's terms alone, counted within each row: no shuffle of the corpus."""
    for f in fields:
        pages = pages.withColumn(f"__{f}", analyze(F.col(f), f not in _UNSTOPPED))
    found = [F.filter(F.array(*(_hit(f, t) for t in terms)), lambda h: h["tf"] > 0) for f in fields]
    return pages.select(F.col(key), F.explode(F.concat(*found)).alias("h")).select(key, "h.*")


def query_terms(spark: SparkSession, query: str, fields: dict[str, float] = FIELDS) -> dict[str, list[str]]:
    """The distinct terms of a query for each field, by that field's analyzer."""
    one = spark.range(1).select(*(F.array_distinct(analyze(F.lit(query), f not in _UNSTOPPED)).alias(f) for f in fields)).first()
    return {f: list(one[f]) for f in fields}


def ranked(hits: DataFrame, stats: DataFrame, terms: dict[str, list[str]], fields: dict[str, float] = FIELDS, key: str = "url") -> DataFrame:
    """(key, score) from the postings of a query's terms and the statistics of the fields."""
    hits = hits.where(reduce(lambda a, b: a | b, ((F.col("field") == f) & F.col("term").isin(terms[f] or [""]) for f in fields)))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))  # a few rows: fields x query terms
    weighted = hits.join(F.broadcast(df.join(F.broadcast(stats), "field")), ["field", "term"])
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    boost = F.element_at(F.create_map(*[F.lit(x) for pair in fields.items() for x in pair]), F.col("field"))
    per_field = weighted.groupBy(key, "field").agg(F.sum(idf * norm * boost).alias("s"))
    return per_field.groupBy(key).agg(F.max("s").alias("score"))


def scores(pages: DataFrame, query: str, fields: dict[str, float] = FIELDS, key: str = "url") -> DataFrame:
    """(key, score) of the pages that hold a term of the query in some field, by a scan of the pages; ``Index`` needs none."""
    terms = query_terms(pages.sparkSession, query, fields)
    every = sorted({t for x in terms.values() for t in x})
    if not every:
        return pages.select(key, F.lit(0.0).alias("score")).limit(0)
    return ranked(matching_counts(pages, every, fields, key), field_stats(pages, fields), terms, fields, key)


@dataclass(frozen=True)
class Index:
    """A stored index below ``folder``: postings in segments that are sorted by term, so that a query reads the row groups of its terms only,
    the statistics of the fields, and the pages by url within segments. Made once by ``build``, it serves any number of queries."""

    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, pages: DataFrame, folder: str) -> Index:
        """A segment holds the postings of one partition of the pages: nothing is shuffled, and a frequent term is spread over all segments."""
        _counted(pages, FIELDS, "url").sortWithinPartitions("term", "url").write.mode("overwrite").parquet(f"{folder}/postings")
        firsts = pages.sparkSession.read.parquet(f"{folder}/postings").where("first")
        firsts.groupBy("field").agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
        pages.sortWithinPartitions("url").write.mode("overwrite").parquet(f"{folder}/pages")
        return cls(pages.sparkSession, folder)

    def scores(self, query: str) -> DataFrame:
        terms = query_terms(self.spark, query)
        every = sorted({t for x in terms.values() for t in x})
        hits = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("term").isin(every or [""]))
        return ranked(hits, self.spark.read.parquet(f"{self.folder}/stats"), terms)

    def pages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/pages")

    def search(self, query: str, **how: Any) -> DataFrame:
        return shown(self.pages(), self.scores(query), query, **how)

    def total_hits(self, query: str, domain: str | None = None) -> DataFrame:
        found = self.scores(query)
        if domain is not None:
            found = found.join(self.pages().where(F.col("domain") == domain).select("url"), "url", "left_semi")
        return found.agg(F.count("*").alias("total"))


def snippet(content: Column, terms: list[str], size: int = FRAGMENT) -> Column:
    """A fragment around the first hit with the query's terms marked; empty without a hit."""
    pattern = r"(?iu)(?<![\p{L}\p{Nd}])(" + "|".join(terms) + r")(?![\p{L}\p{Nd}])"
    at = F.regexp_instr(content, F.lit(pattern))
    start = F.greatest(F.lit(1), at - 40)
    return F.when(at > 0, F.regexp_replace(F.substr(content, start, F.lit(size)), pattern, "<em>$1</em>")).otherwise("")


_HITS = 1_000


def shown(pages: DataFrame, found: DataFrame, query: str, domain: str | None = None, size: int = 10, offset: int = 0, sort_by: str | None = None, descending: bool = True) -> DataFrame:
    """url, title, snippet, domain, crawled_at, score of one page of results. The domain filters and does not score; ``size`` 0 returns nothing.

    The first hits are chosen by score, or by the column that sorts alone, before the pages are read for them.
    """
    if domain is not None:
        found = found.join(pages.where(F.col("domain") == domain).select("url"), "url", "left_semi")
    order = [F.desc("score") if sort_by is None else (F.desc(sort_by) if descending else F.asc(sort_by)), F.asc("url")]
    keyed = found if sort_by in (None, "score", "url") else found.join(pages.select("url", sort_by), "url")
    found = keyed.orderBy(*order).limit(offset + size).select("url", "score").distinct()
    rows = pages.join(F.broadcast(found) if offset + size <= _HITS else found, "url")
    top = rows.orderBy(*order).offset(offset).limit(size)
    words = sorted({t for x in query_terms(pages.sparkSession, query).values() for t in x}) or ["\\x00"]
    return top.select("url", "title", snippet(F.col("content"), words).alias("snippet"), "domain", "crawled_at", "score")


def search(pages: DataFrame, query: str, **how: Any) -> DataFrame:
    """Like ``Index.search``, by a scan of the pages."""
    return shown(pages, scores(pages, query), query, **how)


def total_hits(pages: DataFrame, query: str, domain: str | None = None) -> DataFrame:
    shown = pages if domain is None else pages.where(F.col("domain") == domain)
    return shown.join(scores(pages, query), "url", "left_semi").agg(F.count("*").alias("total"))


def get_by_url(pages: DataFrame, url: str) -> DataFrame:
    """Point look-up; metadata are not part of the answer."""
    return pages.where(F.col("url") == url).limit(1).drop("metadata", "meta_description")
