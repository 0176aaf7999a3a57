from pyspark.sql import functions as F

from gossamer.sources import storage
from gossamer.streaming import crawl_stream as CS


def stream_of(spark, folder, df, parts=2):
    df.repartition(parts).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, name, tmp_path, mode="append"):
    folder = str(tmp_path / name)
    q = CS.sink(stream, folder, mode).start()
    q.awaitTermination(120)
    assert CS.stop_between_batches(q)
    return CS.result(stream.sparkSession, folder, stream.schema, mode)


def test_seen_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"https://h.com/{i % 5}?utm_source={i}") for i in range(20)], "seq long, raw string")
    stream = CS.new_urls(stream_of(spark, str(tmp_path / "u"), df))
    assert run(stream, "seen_once", tmp_path).count() == 5
    assert run(stream, "seen_once", tmp_path).count() == 5  # a restart adds nothing


def test_dispatch(spark, tmp_path):
    rows = [(i, "h", f"u{i}", i * 10, s) for i, s in enumerate([200, 500, 500, 200, 200])]
    df = spark.createDataFrame(rows, "seq long, host string, url string, arrival_ms long, status_code int")
    rows = run(CS.dispatch(stream_of(spark, str(tmp_path / "d"), df, 1)), "dispatched", tmp_path)
    got = [r["dispatch_ms"] for r in rows.orderBy("seq").collect()]
    assert got == [0, 1000, 3000, 7000, 8000]


def test_stats(spark, tmp_path):
    df = spark.range(60).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"), F.when(F.col("id") % 10 == 0, "failed").otherwise("completed").alias("outcome"), F.lit("h").alias("host"), F.lit("w").alias("worker_id"))
    rows = run(CS.periodic_stats(stream_of(spark, str(tmp_path / "s"), df, 1)), "stats", tmp_path, "complete").orderBy("start").collect()
    assert [r["events"] for r in rows] == [10] * 6 and all(r["failed"] == 1 for r in rows)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "h1", "alpha beta gamma delta words"), (2, "h2", "alpha beta gamma delta words"), (3, "h3", "entirely other sentence about spiders"), (4, "h1", "alpha beta gamma delta words")], "seq long, content_hash string, content string")
    folder = str(tmp_path / "kept")
    stream = stream_of(spark, str(tmp_path / "n"), df, 1)
    q = stream.writeStream.foreachBatch(CS.near_dedup_sink(folder)).option("checkpointLocation", str(tmp_path / "cp_n")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["seq"] for r in storage.read_table(spark, folder).collect()) == [1, 3]
    write = CS.upsert_sink(str(tmp_path / "up"))
    write(df, 0)
    write(df, 0)
    assert storage.read_table(spark, str(tmp_path / "up")).count() == 3
