"""Raw bodies and indexed pages as Parquet tables, with idempotent upserts by content hash."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions import url as U

INDEX_SCHEMA = (
    "url string, final_url string, domain string, title string, content string, meta_description string, links_out array<string>, links_count int, "
    "content_hash string, simhash long, depth int, status_code int, crawled_at timestamp, fetch_duration_ms long, content_length int"
)


def raw_rows(pages: DataFrame) -> DataFrame:
    """content_hash, prefix, path, html: one row per digest."""
    rows = pages.where(F.col("content_hash") != "").groupBy("content_hash").agg(F.first("html").alias("html"))
    return rows.select("content_hash", F.substring("content_hash", 1, 2).alias("prefix"), U.raw_path("content_hash").alias("path"), F.encode("html", "UTF-8").alias("html"))


def store_raw(pages: DataFrame, folder: str) -> None:
    """Bodies by prefix of their digest, gzip-compressed; digests that are stored already are skipped."""
    spark = pages.sparkSession
    new = raw_rows(pages)
    if exists(spark, folder):
        new = new.join(spark.read.parquet(folder).select("content_hash"), "content_hash", "left_anti")
    new.repartition("prefix").write.mode("append").partitionBy("prefix").option("compression", "gzip").parquet(folder)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def raw_body(spark: SparkSession, folder: str, content_hash: str) -> DataFrame:
    """One body; only its prefix's partition is read."""
    return spark.read.parquet(folder).where((F.col("prefix") == content_hash[:2]) & (F.col("content_hash") == content_hash)).select(F.decode("html", "UTF-8").alias("html")).limit(1)


def raw_exists(spark: SparkSession, folder: str, content_hash: str) -> bool:
    return exists(spark, folder) and not raw_body(spark, folder, content_hash).isEmpty()


def _file_system(spark: SparkSession, folder: str) -> tuple[Any, Any]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())


_SET_ASIDE = "_before-"


def repair_raw(spark: SparkSession, folder: str) -> None:
    """Put back what a deletion that never ended had set aside."""
    hadoop, fs = _file_system(spark, folder)
    for status in fs.listStatus(hadoop(folder)) if fs.exists(hadoop(folder)) else ():
        name = status.getPath().getName()
        if name.startswith(_SET_ASIDE):
            target = hadoop(f"{folder}/{name.removeprefix(_SET_ASIDE)}")
            if fs.exists(target):
                fs.delete(status.getPath(), True)
            else:
                fs.rename(status.getPath(), target)


def delete_raw(spark: SparkSession, folder: str, hashes: list[str]) -> None:
    """Rewrite the partitions of these digests without them, and no others.

    The old partition is set aside, not deleted, until the new one is in its place: a driver lost
    between leaves both, and ``repair_raw``, which every deletion begins with, puts the old one back.
    """
    repair_raw(spark, folder)
    prefixes = sorted({h[:2] for h in hashes})
    kept = spark.read.parquet(folder).where(F.col("prefix").isin(prefixes) & ~F.col("content_hash").isin(hashes))
    moved = f"{folder.rstrip('/')}-{uuid.uuid4().hex}"
    kept.write.partitionBy("prefix").option("compression", "gzip").parquet(moved)
    hadoop, fs = _file_system(spark, folder)
    for prefix in prefixes:
        target, aside, source = (hadoop(f"{x}prefix={prefix}") for x in (f"{folder}/", f"{folder}/{_SET_ASIDE}", f"{moved}/"))
        if fs.exists(target):
            fs.rename(target, aside)
        if fs.exists(source):
            fs.rename(source, target)
        fs.delete(aside, True)
    fs.delete(hadoop(moved), True)
    spark.catalog.refreshByPath(folder)


def raw_stats(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).agg(F.count("*").alias("objects"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes"))


def index_rows(results: DataFrame) -> DataFrame:
    """The indexed projection of crawl results."""
    seconds = (F.col("fetch_seconds") * 1000).cast("long")
    return results.select(
        "seq", "url", "final_url", "domain", "title", "content", "meta_description", F.col("links").alias("links_out"), F.col("links_count").cast("int").alias("links_count"), "content_hash",
        "simhash", F.col("depth").cast("int").alias("depth"), F.col("status_code").cast("int").alias("status_code"), "crawled_at", seconds.alias("fetch_duration_ms"), F.col("content_length").cast("int").alias("content_length"),
    )


def last_write(rows: DataFrame, key: str = "content_hash", seq: str = "seq") -> DataFrame:
    """The last row of each key wins."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(seq)).alias("__r")).select(key, "__r.*").select(*rows.columns)


def ensure_index(spark: SparkSession, table: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(f'{p.strip()}' for p in INDEX_SCHEMA.replace('array<string>', 'ARRAY<STRING>').split(', '))}) USING parquet")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions of a versioned table, oldest first. A version counts once its writer has put the success mark there."""
    hadoop, fs = _file_system(spark, folder)
    found = fs.listStatus(hadoop(folder)) if fs.exists(hadoop(folder)) else ()
    names = [s.getPath().getName() for s in found if fs.exists(hadoop(f"{folder}/{s.getPath().getName()}/_SUCCESS"))]
    return sorted(int(n.removeprefix(_VERSION)) for n in names if n.startswith(_VERSION))


_VERSION = "version-"


def read_table(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last complete version of a versioned table; None where there is none."""
    known = versions(spark, folder)
    return spark.read.parquet(f"{folder}/{_VERSION}{known[-1]}") if known else None


def write_table(rows: DataFrame, folder: str) -> None:
    """The next version. Readers see the old one until the new one is complete; the one before that is then deleted.

    A driver lost at any point leaves the old version. Two writers at once cannot both write the same version: one fails.
    """
    spark = rows.sparkSession
    known = versions(spark, folder)
    hadoop, fs = _file_system(spark, folder)
    number = (known[-1] if known else 0) + 1
    target = f"{folder}/{_VERSION}{number}"
    if fs.exists(hadoop(target)) and not fs.exists(hadoop(f"{target}/_SUCCESS")):
        fs.delete(hadoop(target), True)  # left by a writer that was lost
    rows.write.parquet(target)
    for old in known[:-1]:
        fs.delete(hadoop(f"{folder}/{_VERSION}{old}"), True)


def upsert(folder: str, rows: DataFrame, key: str = "content_hash", seq: str = "seq") -> None:
    """Merge rows into the versioned table at ``folder``: what is there stays unless a new row has its key."""
    new = last_write(rows, key, seq)
    old = read_table(rows.sparkSession, folder)
    write_table(new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True), folder)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def queue_to_json(queue: DataFrame) -> DataFrame:
    """Queue items as the JSON strings that are exchanged with other systems."""
    return queue.select("host", "seq", F.to_json(F.struct(*[c for c in queue.columns if c not in ("seq",)])).alias("item"))


def queue_from_json(items: DataFrame, schema: str = "raw string, normalized string, url_hash string, host string, depth int, priority int, source_url string") -> DataFrame:
    return items.select("seq", F.from_json("item", schema).alias("u")).select("seq", "u.*")
