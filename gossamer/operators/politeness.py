"""Per-host delays: dispatch times, back-off, robots rules and their expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.config import EngineConfig
from gossamer.functions import robots as R
from gossamer.operators import running


def schedule(arrivals: DataFrame, delay_ms: int, host: str = "host", at: str = "arrival_ms", seq: str = "seq") -> DataFrame:
    """Earliest dispatch of each URL when its host is fetched at most once per ``delay_ms``.

    t(k) = max(a(k), t(k-1) + d) is k d + max over j <= k of (a(j) - j d): a running maximum, not a loop.
    A hot host is worked on in pieces: each needs the count and the maximum of those before it.
    """
    pieces = running.Pieces.of(arrivals, host, [at, seq])
    local = pieces.rows.withColumn("__j", (F.col("__k") - 1).cast("long"))
    early = F.col(at) - F.col("__j") * delay_ms
    ends = local.groupBy("__p", host).agg(F.count(F.lit(1)).alias("__n"), F.max(early).alias("__m"))
    counted = pieces.joined(pieces.carried(ends, lambda w: F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__base")), ends)
    before = pieces.carried(counted.withColumn("__c", F.col("__m") - F.col("__base") * delay_ms), lambda w: F.max("__c").over(w).alias("__carry"))
    both = pieces.joined(pieces.joined(counted.select("__p", host, "__base"), before), local.withColumn("__own", F.max(early).over(pieces.within)))
    k = F.col("__base") + F.col("__j")
    latest = F.greatest(F.col("__own") - F.col("__base") * delay_ms, F.col("__carry"))  # greatest skips a null carry
    return both.select(*arrivals.columns, k.alias("k"), (k * delay_ms + latest).alias("dispatch_ms"))


def backoff_delay(errors_in_row: Column, config: EngineConfig = EngineConfig()) -> Column:
    """The delay doubles with each overload answer (429 or 500 and above) up to the maximum."""
    doubled = F.lit(float(config.default_delay_ms)) * F.pow(F.lit(2.0), F.least(errors_in_row, F.lit(32)))
    return F.least(doubled, F.lit(float(config.max_delay_ms))).cast("long")


def is_overload(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def backoff_states(log: DataFrame, config: EngineConfig = EngineConfig(), host: str = "host", seq: str = "seq") -> DataFrame:
    """The host's delay after each fetch: it grows with overload answers since the last other answer, which resets it.

    A hot host is worked on in pieces: what goes on into a piece is the run of overload answers at the end of those before it.
    """
    pieces = running.Pieces.of(log, host, [seq])
    bad = is_overload(F.col("status_code"))
    local = pieces.rows.withColumn("__bad", F.coalesce(bad, F.lit(False))).withColumn("__reset", F.max(F.when(~F.col("__bad"), F.col("__k"))).over(pieces.within))
    ends = local.groupBy("__p", host).agg(F.max("__k").alias("__n"), F.max("__reset").alias("__reset"))
    tails = ends.select("__p", host, (F.col("__n") - F.coalesce("__reset", F.lit(0))).alias("__tail"), F.col("__reset").isNotNull().cast("int").alias("__resets"))
    by_piece = Window.partitionBy(host).orderBy("__p")
    since = tails.withColumn("__since", F.sum("__resets").over(by_piece)).withColumn("__run", F.sum("__tail").over(Window.partitionBy(host, "__since").orderBy("__p")))
    before = since.select("__p", host, F.coalesce(F.lag("__run").over(by_piece), F.lit(0)).alias("__carry"))
    streak = F.col("__k") - F.coalesce("__reset", F.lit(0)) + F.when(F.col("__reset").isNull(), F.col("__carry")).otherwise(0)
    return pieces.joined(before, local).withColumn("delay_ms", backoff_delay(streak, config)).select(*log.columns, "delay_ms")


def robots_table(bodies: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """host, rules, crawl_delay_ms, expires_ms; any status but 200 allows everything."""
    body = F.when(F.col("status") == 200, F.col("body")).otherwise("")
    parsed = bodies.withColumn("g", R.parse_robots(config.user_agent)(body))
    return parsed.select("host", "g.rules", (F.col("g.crawl_delay") * 1000).cast("long").alias("crawl_delay_ms"), (F.col("fetched_ms") + config.robots_ttl_ms).alias("expires_ms"))


def valid_robots(table: DataFrame, now_ms: int) -> DataFrame:
    return table.where(F.col("expires_ms") > now_ms)


def invalidate_robots(table: DataFrame, hosts: list[str]) -> DataFrame:
    return table.where(~F.col("host").isin(hosts))


def prefetch_robots(table: DataFrame, hosts: DataFrame, bodies: DataFrame, now_ms: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The table with fresh rows for those of ``hosts`` that have no valid one; ``bodies`` are their fetched files."""
    valid = valid_robots(table, now_ms)
    wanted = hosts.select("host").distinct().join(valid.select("host"), "host", "left_anti")
    return valid.unionByName(robots_table(bodies.join(wanted, "host", "left_semi"), config))


def with_robots(urls: DataFrame, table: DataFrame) -> DataFrame:
    """URLs with ``allowed`` and ``crawl_delay_ms``; a host without robots rules allows everything.

    The join is left to the planner: robots rows grow with the number of hosts, so no broadcast is forced.
    """
    joined = urls.join(table.select("host", "rules", "crawl_delay_ms"), "host", "left")
    return joined.withColumn("allowed", R.is_allowed("rules", "normalized")).drop("rules")


def host_delays(politeness: DataFrame, robots: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """A host's delay: its own state, or else the default, but at least what its robots rules ask for."""
    both = politeness.join(robots.select("host", "crawl_delay_ms"), "host", "full_outer")
    asked = F.coalesce("crawl_delay_ms", F.lit(0)) if config.apply_crawl_delay else F.lit(0)
    return both.select("host", "last_fetch_ms", F.greatest(F.coalesce("delay_ms", F.lit(config.default_delay_ms)), asked).cast("long").alias("delay_ms"))
