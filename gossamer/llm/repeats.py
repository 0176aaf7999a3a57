"""Which hashed entries occur more than once, in blocks of sorted arrays instead of rows.

An entry is (hash, second hash, key, tag, place); it is its document's, told by key and tag. Tasks send the entries of many
documents as compressed blocks, one for each range of hash values; a hash that is frequent within a batch is sent once, so
that no range receives more than one entry of a hash from each batch, however common it is. The answer is regrouped by document.

Memory: the number of ranges follows the data, so that a range holds about ``RANGE`` entries; a task holds one range at a time,
and of a hash with many entries one. Partitions are as many as the session says, each with several ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import map_batches

BLOCK = "bucket int, known boolean, n int, block binary"
RANGE = 400_000
_BATCH = 300_000
_HELD = 1_000_000
_KINDS = ("uint64", "uint64", "int64", "int32", "int32", "uint8")


@dataclass(frozen=True)
class Ranges:
    """``n`` ranges of hash values, dealt in order to ``partitions``."""

    n: int
    partitions: int

    @classmethod
    def over(cls, df: DataFrame, entries: float) -> Ranges:
        """Ranges for about so many entries."""
        partitions = min(65_536, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        return cls(min(1 << 30, max(partitions, int(entries / RANGE) + 1)), partitions)

    def deal(self, blocks: DataFrame, *order: str) -> DataFrame:
        return blocks.repartitionById(self.partitions, (F.col("bucket").cast("long") * self.partitions / self.n).cast("int")).sortWithinPartitions(*order)


def pack(*arrays: np.ndarray) -> bytes:
    """Byte planes of the arrays, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(block: pa.Buffer | bytes, n: int, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw, out, at = np.frombuffer(pa.decompress(block, n * sum(sizes), codec="zstd"), np.uint8), [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _runs(sorted_ranges: np.ndarray) -> Iterator[tuple[int, slice]]:
    starts = np.flatnonzero(np.diff(sorted_ranges, prepend=-1))
    return ((int(sorted_ranges[a]), slice(int(a), int(b))) for a, b in zip(starts, np.append(starts[1:], len(sorted_ranges)), strict=True))


def _rows(rows: list[tuple[int, bool, int, bytes]]) -> dict[str, Any]:
    return dict(zip(("bucket", "known", "n", "block"), map(list, zip(*rows, strict=True)), strict=True))


def _reduce(parts: list[tuple[np.ndarray, ...]], ordered: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """One entry of each hash, marked if it has others (``ordered``: the smallest by key, tag and place); and key, tag and place of the others."""
    h, g, key, tag, place, several = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, tag, key, g, h) if ordered else (g, h))
    h, g = h[order], g[order]
    first = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
    starts = np.flatnonzero(first)
    more = np.maximum.reduceat(several[order], starts) | (np.diff(np.append(starts, len(h))) > 1).astype(np.uint8)
    one, others = order[first], order[~first]
    return [h[first], g[first], key[one], tag[one], place[one], more], [key[others], tag[others], place[others]]


def _known(key: np.ndarray, tag: np.ndarray, place: np.ndarray, n: int) -> list[tuple[int, bool, int, bytes]]:
    """Blocks of entries that are repeated, by the range of their document. Entries with a negative place are left out."""
    told = place >= 0
    key, tag, place = key[told], tag[told], place[told]
    if not len(key):
        return []
    to = _range_of((key.view(np.uint64) ^ (tag.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15), n)
    order = np.lexsort((place, tag, key, to))
    return [(k, True, s.stop - s.start, pack(key[order[s]], tag[order[s]], place[order[s]])) for k, s in _runs(to[order])]


class Sender:
    """Collects entries of a task and makes blocks of them."""

    def __init__(self, ranges: int, first_is_kept: bool) -> None:
        self.n, self.first_is_kept = ranges, first_is_kept
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, hashes: np.ndarray, second: np.ndarray | None, key: int, tag: int, places: np.ndarray) -> None:
        m = len(hashes)
        self.parts.append((hashes, np.zeros(m, np.uint64) if second is None else second, np.full(m, key, np.int64), np.full(m, tag, np.int32), places.astype(np.int32), np.zeros(m, np.uint8)))
        self.size += m

    def full(self) -> bool:
        return self.size >= _BATCH

    def blocks(self) -> dict[str, Any] | None:
        if not self.size:
            return None
        one, (key, tag, place) = _reduce(self.parts, self.first_is_kept)
        self.parts, self.size = [], 0
        h, *rest = one
        rows = [(k, False, s.stop - s.start, pack(np.diff(h[s], prepend=np.uint64(0)), *(x[s] for x in rest))) for k, s in _runs(_range_of(h, self.n))]
        return _rows(rows + _known(key, tag, np.ones_like(place) if self.first_is_kept else place, self.n))


def find(blocks: DataFrame, ranges: Ranges, first_is_kept: bool = False) -> DataFrame:
    """(k, tag, runs): for each document, the places whose hash occurs elsewhere too, as runs [from, to), flattened.

    Entries with a negative place take part but are not reported. With
    ``first_is_kept`` the first entry of a repeated hash is reported at place 0, all others at 1.
    """

    def merge(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        parts: list[Any] = []
        held, now = 0, None

        def lessened() -> Iterator[dict[str, Any]]:
            """Report all entries of a hash but one, which is held on."""
            nonlocal parts, held
            one, (key, tag, place) = _reduce(parts, first_is_kept)
            parts, held = [tuple(one)], len(one[0])
            if rows := _known(key, tag, np.ones_like(place) if first_is_kept else place, ranges.n):
                yield _rows(rows)

        def ended() -> Iterator[dict[str, Any]]:
            nonlocal parts, held
            yield from lessened()
            _, _, key, tag, place, several = parts[0]
            parts, held = [], 0
            told = several > 0
            if rows := _known(key[told], tag[told], np.zeros_like(place[told]) if first_is_kept else place[told], ranges.n):
                yield _rows(rows)

        for b in batches:
            for bucket, known, n, block in zip(b["bucket"].to_pylist(), b["known"].to_pylist(), b["n"].to_pylist(), b["block"], strict=True):
                if known:
                    yield {"bucket": [bucket], "known": [True], "n": [n], "block": [block.as_py()]}
                    continue
                if bucket != now and parts:
                    yield from ended()
                now = bucket
                d, *rest = unpack(block.as_buffer(), n, *_KINDS)
                parts.append((np.cumsum(d, dtype=np.uint64), *rest))
                held += n
                if held > 2 * len(parts[0][0]) + _HELD:
                    yield from lessened()
        if parts:
            yield from ended()

    def regroup(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        def rows(parts: list[list[np.ndarray]]) -> dict[str, Any]:
            key, tag, place = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((place, tag, key))
            key, tag, place = key[order], tag[order], place[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])))
            opens = new | np.concatenate(([True], place[1:] > place[:-1] + 1))
            at = np.flatnonzero(opens)
            ends = place[np.append(at[1:], len(place)) - 1] + 1
            runs = np.column_stack((place[at], ends)).ravel().astype(np.int32)
            documents = np.flatnonzero(new)
            offsets = np.append(np.searchsorted(at, documents), len(at)) * 2
            return {"k": key[documents], "tag": tag[documents], "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(runs, pa.int32()))}

        parts, now = [], None
        for b in batches:
            for bucket, n, block in zip(b["bucket"].to_pylist(), b["n"].to_pylist(), b["block"], strict=True):
                if bucket != now and parts:
                    yield rows(parts)
                    parts = []
                now = bucket
                parts.append(unpack(block.as_buffer(), n, "int64", "int32", "int32"))
        if parts:
            yield rows(parts)

    columns = {c: F.col(c) for c in ("bucket", "known", "n", "block")}
    merged = map_batches(ranges.deal(blocks, "bucket", "known"), columns, BLOCK, merge)
    return map_batches(ranges.deal(merged, "bucket"), columns, "k long, tag int, runs array<int>", regroup)


Entry = tuple[np.ndarray, np.ndarray | None, int, int, np.ndarray]


def send(rows: DataFrame, columns: dict[str, Column], entries_of: Callable[[dict[str, Any]], Iterator[Entry]], ranges: Ranges, first_is_kept: bool = False) -> DataFrame:
    """Blocks of the entries that ``entries_of`` yields for each row."""

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        sender = Sender(ranges.n, first_is_kept)
        for b in batches:
            names = list(b)
            for values in zip(*b.values(), strict=True):
                for entry in entries_of(dict(zip(names, (v.as_py() for v in values), strict=True))):
                    sender.add(*entry)
                if sender.full():
                    yield sender.blocks()
        if last := sender.blocks():
            yield last

    return map_batches(rows, columns, BLOCK, run)
