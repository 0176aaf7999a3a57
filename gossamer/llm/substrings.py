"""Removal of repeated word windows by difference-cover anchors.

Windows of the text are hashed only where their position modulo a period lies in
a difference cover. Two equal stretches of ``window`` words have a pair of such
anchors at the same distance from their starts, whatever their positions are, so
anchors that occur once need no more work. Around repeated anchors the match is
extended: every full window that contains one is hashed and counted.

Defined results: a null or empty text has no words; windows never cross
documents; repeated rows are separate documents and so remove each other; rows
that share an id are told apart by their text, a null id is an id like any other; documents shorter than
the window stay whole; an empty table gives an empty result; other columns are
ignored. Hashes are 48 bits for anchors and 64 more for windows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gossamer.llm import repeats
from gossamer.llm.common import column, map_batches, type_of
from gossamer.llm.rolling import second, window_hashes, word_hashes

NO_ID = -(1 << 63)


@functools.cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The smallest set, first in order, whose differences reach every residue of the period."""
    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
        size += 1


@dataclass(frozen=True)
class Windows:
    """``window`` words count as a repeat; anchors are ``window - period + 1`` words long."""

    window: int = 35
    period: int = 21

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1


def _words(text: bytes | None) -> list[bytes]:
    """bytes.split() splits at exactly the six ASCII white-space characters."""
    return (text or b"").split()


def _expand(runs: list[int] | None) -> np.ndarray:
    if not runs:
        return np.zeros(0, np.int64)
    return np.concatenate([np.arange(a, b) for a, b in zip(runs[::2], runs[1::2], strict=True)])


def repeated_windows(docs: DataFrame, rules: Windows = Windows(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, starts): the documents as (k, tag, doc_id, text, first), and where repeated windows start.

    ``first`` is set for texts that have exact copies, and true for one of them. The texts are shuffled once, by
    (k, tag): all joins need the same columns, so that they reuse that exchange.
    """
    w, cover, period, length = rules.window, np.array(difference_cover(rules.period)), rules.period, rules.anchor
    key = F.coalesce(column(id_col).cast("long"), F.lit(NO_ID)).alias("k")
    tag = F.hash(column(text_col)).alias("tag")
    texts = docs.select(key, tag, column(id_col).alias("doc_id"), column(text_col).cast("binary").alias("text"))
    size, rows = docs.agg(F.sum(F.octet_length(column(text_col))), F.count(F.lit(1))).first()
    ranges = repeats.Ranges.over(docs, (size or 0) / 6 * len(cover) / period)

    # exact copies: only the first of them takes part below
    whole = docs.where(column(text_col).isNotNull()).select(key, tag, F.xxhash64(column(text_col), F.lit(1)).alias("a"), F.xxhash64(F.lit(2), column(text_col)).alias("b"))
    one, few = np.zeros(1, np.int32), repeats.Ranges.over(docs, rows)
    digests = lambda r: iter([(np.array([r["a"]]).view(np.uint64), np.array([r["b"]]).view(np.uint64), r["k"], r["tag"], one)])
    copies = repeats.find(repeats.send(whole, {c: F.col(c) for c in ("k", "tag", "a", "b")}, digests, few, True), few, True)
    copies = copies.select("k", "tag", F.array_contains(F.filter("runs", lambda x, i: i % 2 == 0), 0).alias("first"))

    def anchors(r: dict[str, Any]) -> Iterator[repeats.Entry]:
        words = _words(r["text"])
        m = len(words)
        if m >= w:
            at = (np.arange(0, m - length + 1, period)[:, None] + cover[None, :]).ravel()
            at = at[at <= m - length]
            yield window_hashes(word_hashes(words), length, at) & np.uint64(0xFFFFFFFFFFFF0000), None, r["k"], r["tag"], at

    joined = texts.join(copies.hint("shuffle_hash"), ["k", "tag"], "left")
    leading = joined.where(F.col("first").isNull() | F.col("first"))
    # the id goes along for the sake of the exchange alone
    candidates = repeats.find(repeats.send(leading, {c: F.col(c) for c in ("k", "tag", "doc_id", "text")}, anchors, ranges), ranges)

    def extended(r: dict[str, Any]) -> Iterator[repeats.Entry]:
        words = _words(r["text"])
        m = len(words)
        if m >= w:
            near = np.zeros(m + 1, np.int32)
            at = _expand(r["runs"])
            at = at[at < m]
            np.add.at(near, np.maximum(at - (period - 1), 0), 1)
            np.add.at(near, at + 1, -1)
            starts = np.flatnonzero(np.cumsum(near)[: m - w + 1])
            if len(starts):
                h = word_hashes(words)
                yield window_hashes(h, w, starts, 1), window_hashes(second(h), w, starts), r["k"], r["tag"], np.full(len(starts), -1) if r["first"] else starts

    around = joined.join(candidates.hint("shuffle_hash"), ["k", "tag"]).where(F.col("first").isNull() | F.col("first"))
    starts = repeats.find(repeats.send(around, {c: F.col(c) for c in ("k", "tag", "doc_id", "text", "first", "runs")}, extended, ranges), ranges)
    return joined, starts


def dedup_digest(docs: DataFrame, rules: Windows = Windows()) -> DataFrame:
    """The registered query: words, removed words and a digest of those that stay."""
    joined, starts = repeated_windows(docs, rules)
    w = rules.window

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, text, first, runs in zip(b["doc_id"].to_pylist(), b["text"], b["first"].to_pylist(), b["runs"], strict=True):
                words = _words(text.as_py())
                out.append((doc_id, len(words), *_kept(words, first, runs.as_py(), w)))
            yield dict(zip(("doc_id", "n_words", "n_removed", "kept_sha256"), map(list, zip(*out, strict=True)), strict=True))

    last = joined.join(starts.hint("shuffle_hash"), ["k", "tag"], "left")
    return map_batches(last, {"doc_id": F.col("doc_id").cast("long"), **{c: F.col(c) for c in ("text", "first", "runs")}}, "doc_id long, n_words long, n_removed long, kept_sha256 string", run)


def kept_words(words: list[bytes], first: bool | None, runs: list[int] | None, window: int) -> list[bytes]:
    """The words that no repeated window covers. ``first`` is set for documents that have exact copies."""
    if first is not None:
        return [] if len(words) >= window else words
    if not runs:
        return words
    out, at = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out += words[at:a]
        at = max(at, b - 1 + window)
    return out + words[at:]


def _kept(words: list[bytes], first: bool | None, runs: list[int] | None, window: int) -> tuple[int, str]:
    stay = kept_words(words, first, runs, window)
    return len(words) - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()


def without_repeats(docs: DataFrame, rules: Windows = Windows(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text: the words that stay, joined by single spaces."""
    joined, starts = repeated_windows(docs, rules, id_col, text_col)

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "text": [b" ".join(kept_words(_words(t.as_py()), f, r.as_py(), rules.window)).decode("utf-8", "replace") for t, f, r in zip(b["text"], b["first"].to_pylist(), b["runs"], strict=True)]}

    output = StructType([StructField("doc_id", type_of(docs, id_col)), StructField("text", StringType())])
    last = joined.join(starts.hint("shuffle_hash"), ["k", "tag"], "left")
    return map_batches(last, {c: F.col(c) for c in ("doc_id", "text", "first", "runs")}, output, run).toDF(id_col, text_col)
