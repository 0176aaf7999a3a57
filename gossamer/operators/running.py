"""Running values within keys of any size: a key's rows are cut into pieces, and each piece gets what came before it.

Rows are range-partitioned by (key, order), so that a hot key covers several
partitions. Within a piece (the rows of a key in one partition) a window does the
work; across pieces only one summary row each is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gossamer.session import cut_lineage


@dataclass(frozen=True)
class Pieces:
    """``rows`` have their columns, the piece ``__p`` and the place ``__k`` (from 1) within the piece. Pieces of a key rise with the order."""

    rows: DataFrame
    key: str
    order: list[str]

    @classmethod
    def of(cls, rows: DataFrame, key: str, order: list[str]) -> Pieces:
        ranged = rows.repartitionByRange(key, *order).withColumn("__p", F.spark_partition_id())
        fixed = cut_lineage(ranged)  # the pieces must not change when a task is run again
        return cls(fixed.withColumn("__k", F.row_number().over(Window.partitionBy("__p", key).orderBy(*order))), key, order)

    @property
    def within(self) -> WindowSpec:
        """Up to the current row within its piece."""
        return Window.partitionBy("__p", self.key).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def summary(self, *values: Column) -> DataFrame:
        return self.rows.groupBy("__p", self.key).agg(*values)

    def carried(self, summary: DataFrame, value: Callable[[WindowSpec], Column]) -> DataFrame:
        """(__p, key, value over all earlier pieces of the key); one row per piece, at most partitions + keys of them."""
        before = Window.partitionBy(self.key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        return summary.select("__p", self.key, value(before))

    def joined(self, carried: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """Rows (or summaries) with the value of their piece; a null key is a key."""
        left, right = self.rows if rows is None else rows, carried.withColumnsRenamed({"__p": "__p2", self.key: "__key2"})
        return left.join(right, (F.col("__p") == F.col("__p2")) & F.col(self.key).eqNullSafe(F.col("__key2"))).drop("__p2", "__key2")
