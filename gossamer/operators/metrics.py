"""Operational aggregates over a crawl log: counters, cumulative histograms, gauges and rates.

Log columns: seq, worker_id, url, host, status_code, error, fetch_seconds,
content_length, links_count, depth, outcome (completed, failed, duplicate, blocked), ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import url as U

# The upper bounds of the histograms' buckets.
FETCH_SECONDS = [0.1 * 2**i for i in range(10)]
CONTENT_BYTES = [float(1024 * 2**i) for i in range(15)]


def counter(log: DataFrame, *labels: str | Column) -> DataFrame:
    return log.groupBy(*labels).agg(F.count("*").alias("value"))


def fetch_status(log: DataFrame) -> DataFrame:
    """Pages fetched by worker and status."""
    return counter(log, "worker_id", F.when(U.is_success("status_code", "error"), "success").otherwise("error").alias("status"))


def error_label(error: Column, status: Column) -> Column:
    """The category of a fetch error, or the class of a failed status."""
    return F.when(error != "", U.error_category(error)).otherwise(F.concat(F.lit("http_"), F.floor(status / 100).cast("string"), F.lit("xx")))


def error_counts(log: DataFrame) -> DataFrame:
    failed = log.where(~U.is_success("status_code", "error"))
    return counter(failed, "worker_id", error_label(F.coalesce("error", F.lit("")), F.col("status_code")).alias("error_type"))


def histogram(log: DataFrame, value: str, bounds: list[float], *labels: str) -> DataFrame:
    """Cumulative counts per upper bound, with +Inf, and the sum and count; one aggregation, then an unpivot of its few rows."""
    names = [f"b{i}" for i in range(len(bounds))]
    agg = log.groupBy(*labels).agg(*(F.count_if(F.col(value) <= b).alias(n) for n, b in zip(names, bounds, strict=True)), F.sum(value).alias("sum"), F.count(value).alias("count"))
    buckets = F.array(*(F.struct(F.lit(b).alias("le"), F.col(n).alias("bucket_count")) for n, b in zip(names, bounds, strict=True)), F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("bucket_count")))
    return agg.select(*labels, "sum", "count", F.explode(buckets).alias("x")).select(*labels, "x.le", "x.bucket_count", "sum", "count")


def links_extracted(log: DataFrame, max_depth: int) -> DataFrame:
    """Links of pages that are expanded."""
    return log.where((F.col("links_count") > 0) & (F.col("depth") < max_depth)).groupBy("worker_id").agg(F.sum("links_count").alias("value"))


def duplicates(log: DataFrame) -> DataFrame:
    return log.where(F.col("outcome") == "duplicate").agg(F.count("*").alias("value")).select(F.lit("content").alias("type"), "value")


def storage_operations(operations: DataFrame) -> DataFrame:
    return counter(operations, "storage", "operation", "status")


def blocked(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(F.col("outcome") == "blocked").alias("value"))


def js_required(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(U.requires_js("url")).alias("value"))


def queue_depth(queue: DataFrame) -> DataFrame:
    return queue.groupBy("host").agg(F.count("*").alias("depth"))


def active_workers(log: DataFrame, since: str) -> DataFrame:
    return log.where(F.col("ts") >= F.lit(since).cast("timestamp")).agg(F.countDistinct("worker_id").alias("value"))


def outcome_rates(log: DataFrame, every: str = "60 seconds") -> DataFrame:
    """Pages per second and error rate in tumbling windows."""
    seconds = F.unix_timestamp(F.col("window.end")) - F.unix_timestamp(F.col("window.start"))
    grouped = log.groupBy(F.window("ts", every)).agg(F.count("*").alias("pages"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    return grouped.select(F.col("window.start").alias("start"), "pages", (F.col("pages") / seconds).alias("pages_per_second"), (F.col("failed") / F.col("pages")).alias("error_rate"))


def top_domains(pages: DataFrame, n: int = 10) -> DataFrame:
    return pages.groupBy("domain").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "domain").limit(n)


def worker_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("worker_id").agg(F.count("*").alias("pages"), F.count_if(F.col("outcome") == "failed").alias("errors"), F.min("ts").alias("started_at"), F.max("ts").alias("last_seen"))


def composite(queue: DataFrame, log: DataFrame, pages: DataFrame) -> DataFrame:
    """One row of all that the status page shows."""
    hosts = queue.groupBy("host").count()
    q = hosts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("pending"), F.count("*").alias("hosts"))
    done = log.agg(F.count_if(F.col("outcome") == "completed").alias("completed"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    return q.crossJoin(done).crossJoin(pages.agg(F.count("*").alias("indexed")))  # one row each


def approximate_seen(seen: DataFrame, error: float = 0.01) -> DataFrame:
    return seen.agg(F.approx_count_distinct("url_hash", error).alias("approx"))
