"""A Bloom filter over strings, as an explicit object: a numpy bit array that is built per partition and merged by OR.

Joins do not need it (the optimizer has its own); it serves approximate
membership and counts outside of a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bloom:
    def __init__(self, items: int = 10_000_000, error: float = 0.001) -> None:
        self.bits = max(64, math.ceil(-items * math.log(error) / math.log(2) ** 2))
        self.hashes = max(1, math.ceil(math.log(2) * self.bits / items))
        self.field = np.zeros((self.bits + 7) // 8, np.uint8)

    def _at(self, items: list[str]) -> np.ndarray:
        """The bits of each item, as one row."""
        a = np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))
        b = np.fromiter((xxhash.xxh3_64_intdigest(x, 1) | 1 for x in items), np.uint64, len(items))
        return ((a[:, None] + np.arange(self.hashes, dtype=np.uint64) * b[:, None]) % np.uint64(self.bits)).astype(np.int64)

    def add(self, item: str) -> None:
        self.add_all([item])

    def add_all(self, items: Iterable[str]) -> None:
        """Batches of items are hashed and set at once."""
        rest = iter(items)
        while batch := list(islice(rest, 10_000)):
            at = self._at(batch).ravel()
            np.bitwise_or.at(self.field, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def might_contain(self, item: str) -> bool:
        at = self._at([item])[0]
        return bool((self.field[at >> 3] >> (at & 7) & 1).all())

    def count(self) -> int:
        """The estimated number of distinct items, from the share of set bits."""
        ones = int(np.unpackbits(self.field).sum())
        return round(-self.bits / self.hashes * math.log(1 - ones / self.bits)) if ones < self.bits else self.bits

    def clear(self) -> None:
        self.field[:] = 0

    def merge(self, other: Bloom) -> None:
        self.field |= other.field

    @classmethod
    def of(cls, df: DataFrame, column: str, items: int, error: float = 0.001, shards: int = 64) -> Bloom:
        """Built on the executors; one partial filter per shard of the keys reaches the driver. Its size follows from ``items`` and ``error`` alone."""
        empty = cls(items, error)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = cls(items, error)
            for b in batches:
                own.add_all(x for x in b.column(0).to_pylist() if x is not None)
            yield pa.RecordBatch.from_pydict({"field": pa.array([own.field.tobytes()], pa.binary())})

        keys = df.select(F.col(column).cast("string").alias("x")).distinct().coalesce(shards)
        for row in keys.mapInArrow(run, "field binary").toLocalIterator():
            empty.field |= np.frombuffer(row["field"], np.uint8)
        return empty
