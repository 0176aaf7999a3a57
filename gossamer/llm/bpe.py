"""Byte-level BPE encoding and decoding.

Encoding keeps a priority queue of (merge rank, position) over a doubly linked
list of symbols; an entry whose symbols have changed meanwhile is stale and
skipped. Decoding concatenates vocabulary strings. Nothing is trained here: the
vocabulary and merges come from a published tokenizer file.

Defined results: a null or empty text has no tokens; repeated rows get equal
results; an empty table gives an empty result; one word of any length is encoded
in n log n; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gossamer.llm.common import Memo, column, kept_for_task, map_batches, slices, struct_type, type_of

#: White space as the Unicode property has it; Python's own class has four control characters more.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


_LONG = 500_000


def _words(text: str) -> Iterable[str]:
    """The words of a text, one by one where a list of them would be large."""
    return _WORD.findall(text) if len(text) < _LONG else (m[0] for m in _WORD.finditer(text))


def _byte_letters() -> dict[int, str]:
    """The printable stand-in for every byte value in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class ByteBpe:
    """Text -> token ids and back, by one vocabulary. ``words`` keeps the ids of words already seen: some 60 MB at most, until the task ends."""

    def __init__(self, spec: bytes) -> None:
        self.words = Memo(self.ids_of, 300_000, kept=True)
        doc = json.loads(spec)
        vocab: dict[str, int] = doc["model"]["vocab"]
        letters = _byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(doc["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        added = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        self.added = added
        size = max([*vocab.values(), *added.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def ids_of(self, word: str) -> tuple[int, ...]:
        return tuple(self.merge([self.byte_ids[b] for b in word.encode("utf-8", "surrogatepass")]))

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges in rank order, leftmost first among equal ranks."""
        n, pairs = len(symbols), self.pairs
        if n < 2:
            return symbols
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(p[0], i, symbols[i], symbols[i + 1], p[1]) for i in range(n - 1) if (p := pairs.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if p := pairs.get((new, symbols[k])):
                    heapq.heappush(queue, (p[0], i, new, symbols[k], p[1]))
            if (h := before[i]) >= 0 and (p := pairs.get((symbols[h], new))):
                heapq.heappush(queue, (p[0], h, symbols[h], new, p[1]))
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> list[int]:
        if self.split is None:
            return list(chain.from_iterable(map(self.words.__getitem__, _words(text))))
        ids: list[int] = []
        for part in self.split.split(text) if any(t in text for t in self.added) else (text,):
            if part in self.added:
                ids.append(self.added[part])
            else:
                ids.extend(chain.from_iterable(map(self.words.__getitem__, _words(part))))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[bytes, ByteBpe] = kept_for_task({})


def codec(spec: bytes) -> ByteBpe:
    """One codec per task and vocabulary."""
    key = hashlib.sha256(spec).digest()
    if key not in _CODECS:
        _CODECS[key] = ByteBpe(spec)
    return _CODECS[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _spec(df: DataFrame, path: str | None) -> Any:
    """The file is read once by the driver; its size is that of a vocabulary, whatever the data."""
    with open(path or default_vocabulary(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>: the token ids of each whole text."""
    spec = _spec(df, path)

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        bpe = codec(spec.value)
        for b in batches:
            for lo, hi in slices(b["id"]):
                yield {"id": b["id"][lo:hi], "ids": [bpe.encode(t or "") for t in b["text"][lo:hi].to_pylist()]}

    output = StructType([StructField("id", type_of(df, id_col)), *struct_type("ids array<int>")])
    return map_batches(df, {"id": column(id_col), "text": column(text_col)}, output, run).toDF(id_col, "ids")


def decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: vocabulary strings concatenated. A null list gives an empty text."""
    spec = _spec(df, path)

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        bpe = codec(spec.value)
        for b in batches:
            for lo, hi in slices(b["id"]):
                yield {"id": b["id"][lo:hi], "text": [bpe.decode(x or []) for x in b["ids"][lo:hi].to_pylist()]}

    output = StructType([StructField("id", type_of(df, id_col)), *struct_type("text string")])
    return map_batches(df, {"id": column(id_col), "ids": column(ids_col)}, output, run).toDF(id_col, "text")


def round_trip_digest(df: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, decode and digest in one pass, so that neither ids nor texts travel back to the JVM."""
    spec = _spec(df, path)

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        bpe = codec(spec.value)
        for b in batches:
            for lo, hi in slices(b["id"]):
                counts, ids_sha, text_sha = [], [], []
                for t in b["text"][lo:hi].to_pylist():
                    ids = bpe.encode(t or "")
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                yield {"doc_id": b["id"][lo:hi], "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return map_batches(df, {"id": F.col("doc_id").cast("long"), "text": F.col("text")}, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def tokenized(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids array<int>, exact (whether the ids decode to the text)."""
    spec = _spec(df, path)

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        bpe = codec(spec.value)
        for b in batches:
            for lo, hi in slices(b["id"]):
                texts = [t or "" for t in b["text"][lo:hi].to_pylist()]
                ids = [bpe.encode(t) for t in texts]
                yield {"id": b["id"][lo:hi], "n_tokens": [len(x) for x in ids], "ids": ids, "exact": [bpe.decode(x) == t for x, t in zip(ids, texts, strict=True)]}

    output = StructType([StructField("id", type_of(df, id_col)), *struct_type("n_tokens long, ids array<int>, exact boolean")])
    return map_batches(df, {"id": column(id_col), "text": column(text_col)}, output, run).toDF(id_col, "n_tokens", "ids", "exact")
