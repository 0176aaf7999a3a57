"""The crawl as Structured Streaming: deduplication, per-host dispatch with back-off, periodic statistics and upserts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from gossamer.config import EngineConfig
from gossamer.functions import text as T
from gossamer.functions.batches import bounded
from gossamer.operators import dedup, frontier
from gossamer.operators.politeness import robots_table
from gossamer.session import cut_lineage
from gossamer.sources import storage

DISPATCH = "host string, seq long, url string, arrival_ms long, dispatch_ms long, delay_ms long"


def new_urls(urls: DataFrame, within: str | None = None, event_time: str = "ts") -> DataFrame:
    """Canonical URLs not seen before in the stream.

    Without ``within`` the key state is exact and grows with the number of URLs,
    as a crawl's seen set does; with it, state older than the watermark is dropped.
    """
    rows = frontier.canonical(urls)
    return rows.dropDuplicates(["url_hash"]) if within is None else rows.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["url_hash"])


class HostDispatcher(StatefulProcessor):
    """Per host: when it may be fetched next, and its delay, which doubles with overload answers and resets otherwise."""

    def __init__(self, default_ms: int, most_ms: int, ttl_ms: int | None = None) -> None:
        self.default_ms, self.most_ms, self.ttl_ms = default_ms, most_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("host", "next_ms long, delay_ms long", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        next_ms, delay = self.state.get() if self.state.exists() else (None, self.default_ms)
        out = []
        # one host's rows of one trigger, which the source's limits per trigger bound
        for row in pd.concat([*rows]).sort_values(["arrival_ms", "seq"]).itertuples():
            at = row.arrival_ms if next_ms is None else max(row.arrival_ms, next_ms)
            overload = row.status_code == 429 or row.status_code >= 500
            delay = min(delay * 2, self.most_ms) if overload else self.default_ms
            next_ms = at + delay
            out.append((key[0], row.seq, row.url, row.arrival_ms, at, delay))
        self.state.update((int(next_ms), int(delay)))
        yield pd.DataFrame(out, columns=["host", "seq", "url", "arrival_ms", "dispatch_ms", "delay_ms"])

    def close(self) -> None:
        pass


def dispatch(fetches: DataFrame, config: EngineConfig = EngineConfig(), ttl_ms: int | None = None) -> DataFrame:
    """Dispatch times of a stream with host, seq, url, arrival_ms, status_code. Needs the RocksDB state store.

    State survives restarts with the checkpoint; ``ttl_ms`` drops hosts that stay silent.
    """
    processor = HostDispatcher(config.default_delay_ms, config.max_delay_ms, ttl_ms)
    return fetches.select("host", "seq", "url", "arrival_ms", "status_code").groupBy("host").transformWithStateInPandas(statefulProcessor=processor, outputStructType=DISPATCH, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def periodic_stats(log: DataFrame, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Outcome counts in tumbling windows; rows later than ``late`` are dropped."""
    grouped = log.withWatermark("ts", late).groupBy(F.window("ts", every))
    return grouped.agg(F.count("*").alias("events"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.approx_count_distinct("host").alias("hosts")).select(F.col("window.start").alias("start"), "events", "failed", "hosts")


def worker_sessions(log: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions of workers."""
    grouped = log.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "worker_id")
    return grouped.agg(F.count("*").alias("events")).select("worker_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def upsert_sink(folder: str, key: str = "content_hash") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merging by key makes a repeated batch harmless."""

    def write(batch: DataFrame, epoch: int) -> None:
        storage.upsert(folder, batch, key)

    return write


def near_dedup_sink(folder: str, distance: int = 3) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keep rows (seq, content_hash, content) that are near none kept so far; earlier rows win."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bounded(spark)  # a stream's batches have a session of their own
        rows = cut_lineage(batch.select("seq", "content_hash", T.simhash("content").alias("simhash")))  # fingerprints are made once
        old = storage.read_table(spark, folder)
        storage.upsert(folder, dedup.greedy_keep(dedup.exact_first(rows, history=old), distance, history=old), "content_hash")

    return write


def robots_stream(bodies: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Parsed robots rules with their expiry, as they arrive."""
    return robots_table(bodies, config)


def sink(stream: DataFrame, folder: str, mode: str = "append") -> DataStreamWriter:
    """Into Parquet below ``folder``, which all executors share, with the checkpoint beside it.

    Each batch writes its own part anew, so that a repeated batch changes nothing; in mode
    complete each part is the whole result. ``result`` reads it.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)


def result(spark: SparkSession, folder: str, schema: StructType, mode: str = "append") -> DataFrame:
    """What a ``sink`` wrote so far: all parts, or in mode complete the last one."""
    if not storage.exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.where(F.col("epoch") == rows.agg(F.max("epoch")).first()[0])
    return rows.drop("epoch")


def stop_between_batches(query: StreamingQuery, wait_seconds: float = 60.0) -> bool:
    """End a stream without cutting a batch off; whether it was idle. After ``wait_seconds`` the batch under way is given up, and repeated at the next start."""
    end = time.monotonic() + wait_seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(0.05)
    idle = not query.isActive or not query.status["isTriggerActive"]
    query.stop()
    return idle
