"""Crawl rounds over a table of fetched pages: a breadth-first fixpoint with a depth limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.config import EngineConfig
from gossamer.functions import url as U
from gossamer.operators import dedup, frontier, politeness
from gossamer.sources import pages as P
from gossamer.session import cut_lineage


QUEUE_COLUMNS = ("seq", "raw", "depth", "priority", "source_url", "normalized", "host", "url_hash")


@dataclass
class CrawlState:
    """All the state of a crawl; each table is checkpointed at the end of a round."""

    queue: DataFrame
    seen: DataFrame
    stored: DataFrame | None
    log: DataFrame | None


def start(seeds: DataFrame) -> CrawlState:
    """``seeds`` has seq, raw, depth, priority, source_url."""
    queue = cut_lineage(frontier.first_of_batch(frontier.canonical(seeds)).select(*QUEUE_COLUMNS))
    return CrawlState(queue, queue.select("url_hash"), None, None)


def crawl_round(state: CrawlState, pages: DataFrame, robots: DataFrame, config: EngineConfig = EngineConfig()) -> CrawlState:
    """Everything that is queued is fetched, parsed, deduplicated, stored and expanded.

    Robots rules and the join with the fetched pages come before the parse, which
    is done once, and the parsed rows are checkpointed, since three outputs branch from them.
    """
    allowed = politeness.with_robots(state.queue, robots) if config.respect_robots else state.queue.withColumn("allowed", F.lit(True))
    blocked = allowed.where(~F.col("allowed"))
    fetched = allowed.where("allowed").join(frontier_pages(pages), "normalized", "left")
    missing = fetched.where(F.col("html").isNull())
    found = fetched.where(F.col("html").isNotNull()).withColumn("url", F.col("normalized"))
    parsed = cut_lineage(P.parsed(found, config))
    good = parsed.where((F.col("error") == "") & F.col("status_code").between(200, 399))
    bad = parsed.where(~((F.col("error") == "") & F.col("status_code").between(200, 399)))
    history = None if state.stored is None else state.stored.select("content_hash", "simhash")
    judged = cut_lineage(dedup.check_and_store(good.select("seq", "content_hash", "simhash"), config.simhash_distance, history)).where(F.col("duplicate") == "none")
    new = cut_lineage(good.join(judged.select("seq"), "seq", "left_semi"))
    links = frontier.expand_links(new.select("seq", "links", "depth", "priority", "url"), config.max_depth)
    base = state.queue.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    fresh = frontier.add_urls(links.withColumnRenamed("order", "seq"), state.seen)
    queue = cut_lineage(_numbered(fresh, base))
    outcome = lambda df, name: df.select("seq", "normalized", "host", F.lit(name).alias("outcome"))
    duplicates = good.join(judged.select("seq"), "seq", "left_anti")
    log = outcome(blocked, "blocked").unionByName(outcome(missing, "failed")).unionByName(outcome(bad, "failed")).unionByName(outcome(new, "completed")).unionByName(outcome(duplicates, "duplicate"))
    stored = new if state.stored is None else state.stored.unionByName(new, allowMissingColumns=True)
    return CrawlState(queue, cut_lineage(state.seen.unionByName(queue.select("url_hash"))), cut_lineage(stored), cut_lineage(log if state.log is None else state.log.unionByName(log)))


def _numbered(rows: DataFrame, base: int) -> DataFrame:
    """New arrival numbers in the order (page, link): a range sort, then numbers that rise with it; gaps do not matter."""
    numbered = rows.orderBy("seq").withColumn("seq", F.lit(base + 1).cast("long") + F.monotonically_increasing_id())
    return numbered.select(*QUEUE_COLUMNS)


def frontier_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages by the canonical form of their URL; the first of equal ones."""
    keyed = pages.withColumn("normalized", U.normalize_url("url")).where(F.col("normalized").isNotNull())
    others = [c for c in keyed.columns if c not in ("normalized", "url")]
    return keyed.groupBy("normalized").agg(F.min_by(F.struct(*others), "url").alias("__p")).select("normalized", "__p.*")


def crawl(seeds: DataFrame, pages: DataFrame, robots: DataFrame, config: EngineConfig = EngineConfig(), max_rounds: int | None = None) -> CrawlState:
    """Rounds until the queue is empty, at most one more than the depth limit."""
    state = start(seeds)
    for _ in range(config.max_depth + 1 if max_rounds is None else max_rounds):
        if state.queue.isEmpty():
            break
        state = crawl_round(state, pages, robots, config)
    return state


def reachable(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth): the depth at which each URL is first reached over a static link table (src, dst).

    A round per depth expands the URLs found last and leaves out all found before, so that work follows the number of
    links and not of walks; each round is checkpointed. Rounds end early where nothing new is found.
    """
    links = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    last = cut_lineage(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)))
    found = last
    for depth in range(1, max_depth + 1):
        ends = last.join(links, last["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        last = cut_lineage(ends.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found
