"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

Row = tuple[Any, ...]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark from whatever store ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def struct_type(ddl: str) -> StructType:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl)


BATCH_BYTES = 8_000_000
#: What this process keeps between the rows of a task; workers are used again, so every task empties them at its end.
_KEPT: list[Any] = []


class Memo(dict):
    """Short key -> ``make(key)``, at most ``most`` of them: some 20 MB at the default. Longer keys are made each time.

    It belongs to the task that fills it, since ``map_batches`` empties it when the task ends, unless ``kept`` by something that itself goes then.
    """

    LONGEST = 64

    def __init__(self, make: Callable[[Any], Any], most: int = 120_000, kept: bool = False) -> None:
        super().__init__()
        self.make, self.most = make, most
        if not kept:
            _KEPT.append(self)

    def __missing__(self, key: Any) -> Any:
        value = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def kept_for_task(holder: Any) -> Any:
    """Have ``holder.clear()`` called at the end of every task."""
    _KEPT.append(holder)
    return holder


def end_of_task() -> None:
    """Empty what tasks keep, and give freed memory back to the system: an idle worker should be small."""
    for holder in _KEPT:
        holder.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def quoted(name: str) -> str:
    """A column name as a reference, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def type_of(df: DataFrame, name: str) -> DataType:
    """Type of a top-level column, whatever characters its name holds."""
    return df.select(column(name)).schema[0].dataType


def fresh(names: list[str] | tuple[str, ...], wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``names`` is called so (case does not count)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def map_batches(df: DataFrame, columns: dict[str, Column], output: str | StructType, rows_of: Callable[[Iterator[dict[str, pa.Array]]], Iterator[dict[str, Any]]]) -> DataFrame:
    """Run ``rows_of`` over Arrow batches of exactly ``columns``; it yields dicts of the columns of ``output``.

    Only the named columns leave the JVM, so extra columns of the input, whatever
    their names, neither cost transfer nor clash. A batch is bounded in bytes: the session's bound is lowered to
    ``BATCH_BYTES``, since both the JVM's buffers outside of its heap and the worker hold a batch several times over.
    """
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    output = struct_type(output) if isinstance(output, str) else output
    schema = to_arrow_schema(output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = ({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches)
        try:
            for out in rows_of(source):
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in schema], schema=schema)
        finally:
            end_of_task()

    return df.select(*(c.alias(n) for n, c in columns.items())).mapInArrow(run, output)


def slices(array: pa.Array, rows: int = 512) -> Iterator[tuple[int, int]]:
    """Bounds of short runs of a batch, to keep working memory small."""
    for start in range(0, len(array), rows):
        yield start, min(start + rows, len(array))


def sampled(df: DataFrame, key: str, rows: int, total: int | None = None) -> DataFrame:
    """A repeatable sample of about ``rows`` rows: a hash of ``key`` decides, alike at every size."""
    total = df.count() if total is None else total
    keep = min(1.0, rows / max(total, 1))
    if keep >= 1.0:
        return df
    return df.where((F.abs(F.xxhash64(column(key), F.lit("sample")) % F.lit(1_000_003)) < F.lit(int(keep * 1_000_003))))


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread: str, rows: int, counted: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has each key once; rows of a key that is frequent in ``left`` are dealt to several tasks.

    ``spread`` is a column of ``left`` whose values differ within a key, ``rows`` its number of rows, and ``counted`` any table with the same keys as often. A key is frequent from rows / (4 x partitions) rows on, so that at
    most 4 x partitions keys are, whatever the data: that is the bound of the broadcast. Their rows of
    ``right`` are repeated once for each salt.
    """
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(256, rows // (4 * partitions))
    hot = F.broadcast((left if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias("__salts")))
    salt = F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread) + F.spark_partition_id(), F.col("__salts")).cast("int"))
    dealt = left.join(hot, keys, "left").withColumn("__salt", salt).drop("__salts")
    repeated = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")
    return dealt.join(repeated, [*keys, "__salt"], how).drop("__salt")
