"""Tokens, shingles, FNV-1a and SimHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from gossamer.functions.batches import bounded, end_of_task
from gossamer.functions.expr import col, let

#: The 64-bit FNV-1a parameters.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_LEAST_BYTES = 3
_TOKEN = regex.compile(r"[\p{L}\p{Nd}]+")


def tokenize(text: Column | str) -> Column:
    """Lower-case runs of letters and digits that take three bytes or more."""
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{Nd}]+", -1), lambda t: F.octet_length(t) >= _LEAST_BYTES)


def shingles(tokens: Column | str, n: int) -> Column:
    """All runs of ``n`` tokens, joined by spaces; empty where there are fewer."""
    t = col(tokens)
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def fnv1a64(token: Column | str) -> Column:
    """FNV-1a over UTF-8 bytes as a signed long, in two 32-bit limbs, since ANSI arithmetic does not wrap."""
    data = F.hex(F.encode(col(token), "UTF-8"))
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    # the prime is 2**40 + 435: the 2**40 part is a shift of the low limb by 8 into the high one
    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("h"), F.lit(FNV_OFFSET & 0xFFFFFFFF).cast("long").alias("l"))

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.substring(data, i * 2 + 1, F.lit(2)), 16, 10).cast("long")

        def mixed(l: Column) -> Column:  # noqa: E741
            return F.struct(low(acc["h"] * 435 + l * 256 + F.shiftrightunsigned(l * 435, 32)).alias("h"), low(l * 435).alias("l"))

        return let(acc["l"].bitwiseXOR(byte), mixed)

    n = (F.length(data) / 2).cast("int")
    folded = F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), start, step)
    return let(folded, lambda a: F.shiftleft(a["h"], 32).bitwiseOR(a["l"]))


class _Fnv(dict):
    """Token -> hash, for tokens that are not long; emptied when full, and at the end of a task."""

    MOST, LONGEST = 100_000, 64

    def __missing__(self, token: str) -> int:
        h = FNV_OFFSET
        for b in token.encode():
            h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
        if len(token) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[token] = h
        return h


_FNV = _Fnv()


def _tokens(text: str | None) -> list[str]:
    return [t for t in _TOKEN.findall((text or "").lower()) if len(t) >= _LEAST_BYTES or len(t.encode()) >= _LEAST_BYTES]


def _signs(h: np.ndarray) -> int:
    """Bit i is set where more hashes have it than not; 0 without hashes. Counted in parts of bounded size."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def _fingerprint(tokens: list[str]) -> int:
    return _signs(np.fromiter(map(_FNV.__getitem__, tokens), np.uint64, len(tokens)))


def _shingle_hashes(tokens: list[str], n: int) -> np.ndarray:
    """FNV-1a of each run of ``n`` tokens joined by spaces, byte by byte over all runs at once: a run is a slice of all tokens joined."""
    parts = [t.encode() for t in tokens]
    data = np.frombuffer(b" ".join(parts), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    first = starts[: len(parts) - n + 1]
    size = (starts + lengths)[n - 1 :] - first
    order = np.argsort(-size, kind="stable")  # the longest first, so that those with a byte left are a prefix; the order of hashes does not matter
    first, size = first[order], size[order]
    left = np.searchsorted(-size, -np.arange(size[0]), side="left")
    h = np.full(len(first), FNV_OFFSET, np.uint64)
    prime = np.uint64(FNV_PRIME)
    for k, m in enumerate(left):
        h[:m] = (h[:m] ^ data[first[:m] + k]) * prime
    return h


@pandas_udf(LongType())
def _simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    try:
        for batch in texts:
            yield pd.Series([_fingerprint(_tokens(t)) for t in batch], dtype="int64")
    finally:
        _FNV.clear()
        end_of_task()


def simhash(text: Column | str) -> Column:
    """64-bit SimHash of a text, every occurrence of a token counted; as a signed long.

    Measured against a native form (explode, hash, 64 signed sums): the Arrow form
    needs no shuffle and hashes a token once per task. Batches are bounded in bytes.
    """
    bounded()
    return _simhash(text)


def simhash_shingles(n: int):
    """SimHash over shingles of ``n`` tokens; over tokens where there are fewer than ``n``."""

    @pandas_udf(LongType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for batch in texts:
                every = (_tokens(t) for t in batch)
                yield pd.Series([_signs(_shingle_hashes(tokens, n)) if len(tokens) >= n else _fingerprint(tokens) for tokens in every], dtype="int64")
        finally:
            _FNV.clear()
            end_of_task()

    def of(text: Column | str) -> Column:
        bounded()
        return run(text)

    return of


def hamming_distance(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def is_similar(a: Column | str, b: Column | str, threshold: int) -> Column:
    """The threshold itself counts as similar."""
    return hamming_distance(a, b) <= threshold


def content_hash(body: Column | str) -> Column:
    return F.sha2(col(body), 256)


def collapse_whitespace(text: Column | str) -> Column:
    """Runs of space, tab, LF and CR become one space; the ends lose all white space."""
    return F.regexp_replace(F.regexp_replace(col(text), r"[ \t\n\r]+", " "), r"^[\s\x85\p{Z}]+|[\s\x85\p{Z}]+$", "")
