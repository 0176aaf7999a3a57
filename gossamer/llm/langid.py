"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector. A letter n-gram is the element-wise
product of its letters' vectors, each rotated by its place; a document is the
sum of its n-gram vectors; a language is the sum of the unit vectors of its
training documents. The language whose prototype has the highest cosine wins.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if no labelled document exists. Equal texts get equal results,
ties go to the language that sorts first, an empty table gives an empty result,
rows with a null id are predicted but never learned from, and columns other than
id, text and label are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gossamer.llm.common import column, kept_for_task, map_batches, slices, struct_type, type_of

UNDETERMINED = "und"


@dataclass(frozen=True)
class Space:
    """The random space: letters' vectors follow from the seed alone, so every worker has the same."""

    dims: int = 512
    order: int = 3
    seed: int = 7


class Encoder:
    """Texts -> document vectors. Letters get small codes as they are seen, so that an n-gram's row is one table look-up.

    At most about ``most`` n-grams have a row, of ``dims`` bytes each; a text with more of them is bundled in pieces.
    """

    PIECE = 50_000

    def __init__(self, space: Space, most: int = 20_000) -> None:
        self.space, self.most = space, most
        self.alpha = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
        self.reset()

    def reset(self) -> None:
        """Forget letters and n-grams; vectors follow from code points, so nothing changes but time."""
        self.codes = np.zeros(0x110000, np.uint32)
        self.letters = [self.vector(32)]
        self.rows: dict[int, int] = {}
        self.slots = np.full(1 << 18, -1, np.int32)
        self.vectors = np.zeros((1024, self.space.dims), np.int8)

    def vector(self, code: int) -> np.ndarray:
        return np.random.default_rng([self.space.seed, code]).integers(0, 2, self.space.dims).astype(np.int8) * 2 - 1

    def letters_of(self, text: str) -> np.ndarray:
        """Lower-case letters as code points; each run of other characters is one 0 (space), also at both ends."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        points = np.concatenate(([0], np.where(self.alpha[points], points, 0), [0])).astype(np.uint32)
        return points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]

    def row_of(self, key: int) -> int:
        """The row of a packed n-gram, made when first seen."""
        row = self.rows.get(key)
        if row is None:
            row = self.rows[key] = len(self.rows)
            if row >= len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            n, bound = self.space.order, 1
            for place in range(n):
                turns = n - 1 - place
                bound = bound * np.roll(self.letters[(key >> (20 * turns)) & 0xFFFFF], turns)
            self.vectors[row] = bound
        return row

    def pieces(self, text: str | None) -> Iterator[np.ndarray]:
        """The letters of a text in pieces that overlap by all but one of an n-gram's letters; nothing where it has none."""
        points, n = self.letters_of(text) if text else np.zeros(0, np.uint32), self.space.order
        if points.any():
            for lo in range(0, len(points) - n + 1, self.PIECE):
                yield points[lo : lo + self.PIECE + n - 1]

    def grams(self, points: np.ndarray) -> np.ndarray:
        """Rows of all n-grams of a piece."""
        codes = self.codes[points]
        if (unknown := (codes == 0) & (points != 0)).any():
            for c in np.unique(points[unknown]).tolist():
                self.codes[c] = len(self.letters)
                self.letters.append(self.vector(c))
            codes = self.codes[points]
        codes = codes.astype(np.int64)
        n = self.space.order
        keys = np.zeros(len(codes) - n + 1, np.int64)
        for k in range(n):
            keys = (keys << 20) | codes[k : len(codes) - n + 1 + k]
        if n == 3 and len(self.letters) <= 64:
            small = (codes[:-2] << 12) | (codes[1:-1] << 6) | codes[2:]
            rows = self.slots[small]
            if (rows < 0).any():
                for s, key in {*zip(small[rows < 0].tolist(), keys[rows < 0].tolist(), strict=True)}:
                    self.slots[s] = self.row_of(key)
                rows = self.slots[small]
            return rows.astype(np.int64)
        distinct, at = np.unique(keys, return_inverse=True)
        return np.array([self.row_of(k) for k in distinct.tolist()])[at]

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """One vector per text; all zeros where a text has no letter."""
        out = np.zeros((len(texts), self.space.dims), np.float32)
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            for piece in self.pieces(text):
                held.append((i, piece))
                size += len(piece)
                if size >= self.PIECE:
                    self._bundle(held, out)
                    held, size = [], 0
        if held:
            self._bundle(held, out)
        return out

    def _bundle(self, held: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        """Add the n-gram vectors of some pieces to their texts' vectors. All sums are of whole numbers, so pieces change nothing."""
        if len(self.rows) > self.most or len(self.letters) > 0xFFFF:
            self.reset()
        grams = [self.grams(piece) for _, piece in held]
        joined = np.concatenate(grams)
        present = np.flatnonzero(np.bincount(joined, minlength=len(self.rows)))
        place = np.zeros(len(self.rows), np.int64)
        place[present] = np.arange(len(present))
        nth = np.repeat(np.arange(len(held)), [len(g) for g in grams])
        owners = [i for i, _ in held]
        for lo in range(0, len(present), 4096):
            some = present[lo : lo + 4096]
            own = (place[joined] >= lo) & (place[joined] < lo + 4096)
            counts = np.bincount(nth[own] * len(some) + place[joined][own] - lo, minlength=len(held) * len(some))
            np.add.at(out, owners, counts.reshape(len(held), len(some)).astype(np.float32) @ self.vectors[some].astype(np.float32))


_ENCODERS: dict[Space, Encoder] = kept_for_task({})


def encoder(space: Space) -> Encoder:
    if space not in _ENCODERS:
        _ENCODERS[space] = Encoder(space)
    return _ENCODERS[space]


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    prototypes: np.ndarray
    space: Space


def train(labelled: DataFrame, space: Space = Space(), per_language: int = 1_500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Profiles:
    """Bundle about ``per_language`` documents of each language, chosen by a hash of the id; that is the stated bound.

    Only one row of ``dims`` sums for each language reaches the driver, as the model does in any case.
    """
    rows = labelled.select(column(id_col).alias("id"), column(text_col).alias("text"), column(label_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Profiles((), np.zeros((0, space.dims), np.float32), space)
    scale = 1_000_003
    shares = F.from_json(F.lit(json.dumps({lang: max(1, int(scale * min(1.0, per_language / n))) for lang, n in counts.items()})), "map<string,int>")
    keep = F.abs(F.xxhash64("id", F.lit("profile")) % scale) < F.try_element_at(shares, F.col("lang"))

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        enc, sums = encoder(space), {}
        for b in batches:
            langs = np.array(b["lang"].to_pylist(), object)
            for lo, hi in slices(b["lang"], 64):
                v = enc.documents(b["text"][lo:hi].to_pylist())
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(size == 0, 1, size)
                for lang in set(langs[lo:hi]):
                    sums[lang] = sums.get(lang, 0) + v[langs[lo:hi] == lang].sum(0, dtype=np.float64)
        if sums:
            yield {"lang": list(sums), "sums": [s.tolist() for s in sums.values()]}

    partial = map_batches(rows.where(keep), {c: F.col(c) for c in ("lang", "text")}, "lang string, sums array<double>", run)
    total = partial.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("s")).collect()
    languages = tuple(sorted({r["lang"] for r in total}))
    prototypes = np.zeros((len(languages), space.dims))
    for r in total:
        prototypes[languages.index(r["lang"]), r["pos"]] = r["s"]
    size = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return Profiles(languages, (prototypes / np.where(size == 0, 1, size)).astype(np.float32), space)


def identify(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """id, the columns ``keep``, ``lang_col`` and ``score_col`` (the cosine with the best prototype, cut to 0..1)."""
    languages, prototypes, space = [*profiles.languages], profiles.prototypes, profiles.space
    wanted = list(dict.fromkeys([id_col, *keep]))
    names = [f"k{i}" for i in range(len(wanted))]

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        enc = encoder(space)
        for b in batches:
            preds, scores = [], []
            for lo, hi in slices(b["t"], 64):
                v = enc.documents(b["t"][lo:hi].to_pylist())
                size = np.linalg.norm(v, axis=1)
                if not languages:
                    preds += [UNDETERMINED] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                cosine = (v @ prototypes.T) / np.where(size == 0, 1, size)[:, None]
                best = cosine.argmax(1)
                preds += [languages[k] if s else UNDETERMINED for k, s in zip(best.tolist(), size.tolist(), strict=True)]
                scores += np.where(size == 0, 0, np.clip(cosine[np.arange(len(best)), best], 0, 1)).astype(float).tolist()
            yield {n: b[n] for n in names} | {"lang": preds, "score": scores}

    output = StructType([*(StructField(n, type_of(df, c)) for n, c in zip(names, wanted, strict=True)), *struct_type("lang string, score double")])
    columns = {n: column(c) for n, c in zip(names, wanted, strict=True)} | {"t": column(text_col)}
    return map_batches(df, columns, output, run).toDF(*wanted, lang_col, score_col)


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4


def language_digest(docs: DataFrame) -> DataFrame:
    """The registered query: learn from three folds of four, predict all."""
    profiles = train(docs.where(fold(F.col("doc_id")) != 2))
    found = identify(docs, profiles)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
