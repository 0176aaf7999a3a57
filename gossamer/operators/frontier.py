"""The frontier as DataFrames: deduplication against all seen URLs, per-host queues, selection and statistics."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.config import EngineConfig
from gossamer.functions import url as U
from gossamer.operators import running


SHOWN_HOSTS = 20


def first_of_batch(urls: DataFrame, key: str = "url_hash", seq: str = "seq") -> DataFrame:
    """The first row of each key, in arrival order; partial aggregation keeps hot keys off a single task."""
    others = [c for c in urls.columns if c != key]
    picked = urls.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(seq)).alias("__r"))
    return picked.select(key, "__r.*").select(*urls.columns)


def canonical(urls: DataFrame) -> DataFrame:
    """Valid rows with normalized, host and url_hash; invalid ones are dropped."""
    rows = urls.withColumn("__u", U.url_struct("raw"))
    out = rows.select("*", F.col("__u.normalized").alias("normalized"), F.col("__u.host").alias("host")).drop("__u").where(F.col("normalized").isNotNull())
    return out.withColumn("url_hash", U.url_hash("normalized"))


def add_urls(urls: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows that are new: valid, first of their batch and never seen. Exact, and global to all workers."""
    return first_of_batch(canonical(urls)).join(seen.select("url_hash"), "url_hash", "left_anti")


def host_scores(queue: DataFrame) -> DataFrame:
    """Each host's score is the priority of the URL added to it last."""
    return queue.groupBy("host").agg(F.max_by("priority", "seq").alias("score"), F.count("*").alias("pending"))


def host_queue(queue: DataFrame) -> DataFrame:
    """First in, first out within a host; a hot host's queue is numbered in pieces."""
    pieces = running.Pieces.of(queue, "host", ["seq"])
    before = pieces.carried(pieces.summary(F.max("__k").alias("n")), lambda w: F.sum("n").over(w).alias("before"))
    return pieces.joined(before).withColumn("position", F.col("__k") + F.coalesce("before", F.lit(0))).select(*queue.columns, "position")


def oldest_of_hosts(queue: DataFrame) -> DataFrame:
    """Position 1 of each host's queue, by partial aggregation: a hot host costs one row per task."""
    return first_of_batch(queue, "host")


def ready_hosts(scores: DataFrame, politeness: DataFrame, now_ms: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The first hosts by score and name that may be fetched now. Hosts never fetched are ready."""
    window = scores.orderBy("score", "host").limit(config.host_window)
    state = window.join(politeness, "host", "left")
    return state.where(F.col("last_fetch_ms").isNull() | (F.lit(now_ms) > F.col("last_fetch_ms") + F.coalesce("delay_ms", F.lit(config.default_delay_ms))))


def next_batch(queue: DataFrame, politeness: DataFrame, now_ms: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One URL, the oldest, of each ready host."""
    ready = ready_hosts(host_scores(queue), politeness, now_ms, config).select("host", "score")
    return oldest_of_hosts(queue).join(F.broadcast(ready), "host")  # at most host_window rows


def next_url(queue: DataFrame, politeness: DataFrame, now_ms: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The single URL that a worker would take next."""
    return next_batch(queue, politeness, now_ms, config).orderBy("score", "host").limit(1)


def without_taken(queue: DataFrame, taken: DataFrame) -> DataFrame:
    return queue.join(taken.select("url_hash"), "url_hash", "left_anti")


def touch(politeness: DataFrame, taken: DataFrame, now_ms: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Politeness after a dispatch: the hosts taken from have been fetched now."""
    now = taken.select("host").distinct().withColumn("now", F.lit(now_ms).cast("long"))
    both = politeness.join(now, "host", "full_outer")
    return both.select("host", F.coalesce("now", "last_fetch_ms").alias("last_fetch_ms"), F.coalesce("delay_ms", F.lit(config.default_delay_ms).cast("long")).alias("delay_ms"))


def expand_links(pages: DataFrame, max_depth: int) -> DataFrame:
    """Links of pages above the depth limit as new raw URLs; priority is inherited, the page is the source."""
    rows = pages.where(F.col("depth") < max_depth)
    out = rows.select("seq", F.posexplode("links").alias("at", "raw"), (F.col("depth") + 1).alias("depth"), "priority", F.col("url").alias("source_url"))
    return out.select(F.struct("seq", "at").alias("order"), "raw", "depth", "priority", "source_url")


def frontier_stats(queue: DataFrame, log: DataFrame) -> DataFrame:
    """One row: pending URLs, their hosts, completed and failed; ``host_scores`` has the pending URLs of each host.

    ``shown`` maps hosts to pending URLs where a page can list them all, which is up to ``SHOWN_HOSTS`` of them.
    """
    hosts = queue.groupBy("host").count()
    pending = hosts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_pending"), F.count("*").alias("hosts"))
    listed = hosts.orderBy("host").limit(SHOWN_HOSTS + 1).agg(F.collect_list(F.struct("host", "count")).alias("x"))
    none = F.array().cast("array<struct<host:string,count:bigint>>")
    pending = pending.crossJoin(listed.select(F.map_from_entries(F.when(F.size("x") <= SHOWN_HOSTS, F.col("x")).otherwise(none)).alias("shown")))  # one row each
    outcome = log.agg(F.count_if(F.col("outcome") == "completed").alias("completed"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    return pending.crossJoin(outcome)  # one row each


def host_view(queue: DataFrame, politeness: DataFrame, host: str) -> DataFrame:
    """One row for one host: its pending URLs and its politeness, if any is known."""
    pending = queue.where(F.col("host") == host).agg(F.lit(host).alias("host"), F.count("*").alias("pending"))
    state = politeness.where(F.col("host") == host).limit(1).select("host", "last_fetch_ms", "delay_ms")
    return pending.join(state, "host", "left")


def stored_tables(spark: SparkSession, pattern: str = "*") -> list[str]:
    """Names of the catalog's tables that match a shell pattern, sorted."""
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary and fnmatchcase(t.name, pattern))


def clear_queue(spark: SparkSession) -> int:
    """Empty the frontier's tables and the seen set, and nothing else; the number of frontier tables."""
    frontier = stored_tables(spark, "frontier*")
    for name in [*frontier, *stored_tables(spark, "seen*")]:
        spark.sql(f"TRUNCATE TABLE `{name}`")
    return len(frontier)
