"""Toxicity scores by FTRL-proximal logistic regression.

Features are hashed word unigrams (of words and of their stems), bigrams and skip-grams,
present or absent.
The optimiser has a learning rate per coordinate, and its L1 term keeps most
weights at zero, so that the model is a short list of (bin, weight).

Defined results: a null or empty text has the score of the bias alone; equal
texts get equal scores; an empty label table gives 0.5 everywhere; repeated
label rows count once (toxic wins a conflict), null labels and ids are left out
of training; columns other than id and text are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gossamer.llm.common import column, map_batches, sampled, slices, type_of
from gossamer.llm.rolling import word_hashes

_WORD = re.compile(r"\w+")
STEM = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def features(text: str | None, bits: int) -> np.ndarray:
    """Distinct bins of unigrams (words and stems), bigrams and pairs with one word between; bin 0 is the bias."""
    words = _WORD.findall((text or "").lower())
    h = word_hashes(words)
    stem = np.fromiter((xxhash.xxh3_64_intdigest(w[:STEM], 1) for w in words), np.uint64, len(words))
    mixed = [h * _ODD[0], stem * _ODD[1], (h[:-1] * _ODD[1]) ^ ((h[1:] + _ODD[0]) * _ODD[2]), (h[:-2] * _ODD[3]) ^ ((h[2:] + _ODD[1]) * _ODD[2])]
    bins = (np.concatenate(mixed) * _ODD[2]) >> np.uint64(64 - bits)
    return np.unique(np.append(bins, np.uint64(0))).astype(np.int64)


@dataclass(frozen=True)
class Ftrl:
    """Settings of the optimiser; ``most_rows`` bounds the labelled rows that are learned from."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    epochs: int = 6
    most_rows: int = 20_000


@dataclass(frozen=True)
class Weights:
    bins: np.ndarray
    values: np.ndarray
    bits: int

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.bins] = self.values
        return w


def fit(rows: list[np.ndarray], labels: list[int], s: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero weights after some passes over the rows, in the order given."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for x, y in zip(rows, labels, strict=True):
            zi, ni = z[x], n[x]
            w = weight(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha * w
            n[x] = ni + g * g
    w = weight(z, n)
    return np.flatnonzero(w), w[w != 0]


def train(docs: DataFrame, labels: DataFrame, settings: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Weights:
    """Learn from at most about ``settings.most_rows`` labelled rows, chosen by a hash of the id.

    Features are made where the texts are. One task runs the optimiser over the bins of the sample, whose number
    follows the words of those rows; its sparse weights (at most 2**bits pairs) are what reaches the driver.
    """
    label = labels.select(column(id_col).alias("id"), column(label_col).cast("int").alias("y"))
    known = label.where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen = sampled(known, "id", settings.most_rows)
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def bins_of(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        for b in batches:
            for lo, hi in slices(b["y"]):
                yield {c: b[c][lo:hi] for c in ("k", "h", "y")} | {"bins": [features(t, settings.bits).astype(np.int32).tobytes() for t in b["text"][lo:hi].to_pylist()]}

    def learn(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        x, y = [], []
        for b in batches:
            x += [np.frombuffer(v.as_py(), np.int32) for v in b["bins"]]
            y += b["y"].to_pylist()
        if x:
            bins, values = fit(x, y, settings)
            yield {"bin": bins, "weight": values}

    columns = {"k": F.xxhash64("id"), "h": F.xxhash64("text"), "y": F.col("y"), "text": F.col("text")}
    made = map_batches(rows, columns, "k long, h long, y int, bins binary", bins_of)
    found = map_batches(made.repartition(1).sortWithinPartitions("k", "h"), {c: F.col(c) for c in ("bins", "y")}, "bin int, weight double", learn).toPandas()
    return Weights(found["bin"].to_numpy(np.int64), found["weight"].to_numpy(np.float32), settings.bits)


def score(df: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score in 0..1 of each whole text. The broadcast is at most 12 bytes x 2**bits."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        dense, bits = shared.value.dense(), shared.value.bits
        for b in batches:
            total = np.array([float(dense[features(t.as_py(), bits)].sum()) for t in b["text"]])
            yield {"id": b["id"], "score": 1 / (1 + np.exp(-np.clip(total, -35, 35)))}

    output = StructType([StructField("id", type_of(df, id_col)), StructField("score", DoubleType())])
    return map_batches(df, {"id": column(id_col), "text": column(text_col)}, output, run).toDF(id_col, "score")


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 5


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: learn from four folds of five, score all."""
    weights = train(docs, labels.where(fold(F.col("doc_id")) != 0))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return score(docs, weights).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
