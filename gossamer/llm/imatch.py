"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms whose document frequency, counted over all
documents, lies in a band. A document's distinct lexicon terms are sorted and
hashed once for the whole lexicon and once for each of several random subsets of
it, drawn at five rates so that short and long documents both have subsets that
an edit leaves alone.

Defined results: a null text counts as empty; a text without lexicon terms is
fingerprinted by its digest; equal texts have equal fingerprints; documents are
ordered by id, descending, then by a hash of the text, with null ids last; a table of one row
is its own neighbour; an empty table gives an empty result; columns other than
id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import column, join_hot, let, map_batches, sampled
from gossamer.llm.rolling import word_hashes
from gossamer.session import cut_lineage

RATES = (4, 16, 64, 256, 1024)
PER_RATE = 6
N_SUBSETS = len(RATES) * PER_RATE
TERM_BITS = 48


@dataclass(frozen=True)
class Band:
    """Terms in at least ``low`` and at most ``high`` of all documents. At most (mean distinct terms) / ``low`` terms can
    qualify however many documents there are. A lexicon of up to ``most_terms`` (8 bytes each) is broadcast, a larger one joined."""

    low: float = 0.002
    high: float = 0.2
    most_terms: int = 2_000_000


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def terms_of(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct words."""
    hashes = (word_hashes(words_of(text)) >> np.uint64(64 - TERM_BITS)).astype(np.int64)
    hashes.sort()
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))] if len(hashes) else hashes


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    terms, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    distinct, at = np.unique(terms, return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)


def document_frequencies(docs: DataFrame, low: int, high: int, text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(term, df) of the terms in low..high documents, counted exactly over all of them.

    Each task counts the terms of a batch and sends, for every bucket of the hash
    space, one block of sorted hashes and counts: a few bytes a term, and one row
    per task and bucket however frequent a term is.
    """
    spark = docs.sparkSession
    n = buckets or min(4096, int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = [(1 << TERM_BITS) * k // n for k in range(n + 1)]

    def count(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        pending: list[np.ndarray] = []
        size = 0

        def flush() -> dict[str, Any]:
            distinct, counts = np.unique(np.concatenate(pending), return_counts=True)
            cuts = np.searchsorted(distinct, edges)
            blocks = []
            for k in range(n):
                t, c = distinct[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]
                if len(t):
                    gaps = np.diff(t, prepend=np.int64(0))
                    blocks.append((k, pa.compress(np.concatenate((gaps.view(np.uint8).reshape(-1, 8).T.ravel(), c.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel())).tobytes(), codec="zstd", asbytes=True), len(t)))
            return dict(zip(("bucket", "block", "n"), map(list, zip(*blocks, strict=True)), strict=True))

        for b in batches:
            for t in b["text"]:
                pending.append(terms_of(t.as_py()))
                size += len(pending[-1])
                if size > 1_000_000:
                    yield flush()
                    pending, size = [], 0
        if size:
            yield flush()

    def total(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        current, parts, held = None, [], 0

        def done() -> dict[str, Any]:
            terms, counts = _merge(parts)
            good = (counts >= low) & (counts <= high)
            return {"term": terms[good], "df": counts[good]}

        for b in batches:
            for bucket, block, m in zip(b["bucket"].to_pylist(), b["block"], b["n"].to_pylist(), strict=True):
                if bucket != current:
                    if parts:
                        yield done()
                    current, parts, held = bucket, [], 0
                raw = np.frombuffer(pa.decompress(block.as_buffer(), m * 12, codec="zstd"), np.uint8)
                gaps = np.ascontiguousarray(raw[: 8 * m].reshape(8, m).T).view(np.int64).ravel()
                counts = np.ascontiguousarray(raw[8 * m :].reshape(4, m).T).view(np.uint32).ravel()
                parts.append((np.cumsum(gaps), counts.astype(np.int64)))
                held += m
                if held > 2 * len(parts[0][0]) + 1_000_000:
                    parts = [_merge(parts)]
                    held = len(parts[0][0])
        if parts:
            yield done()

    blocks = map_batches(docs, {"text": column(text_col)}, "bucket int, block binary, n int", count)
    dealt = blocks.repartition(n, "bucket").sortWithinPartitions("bucket")
    return map_batches(dealt, {c: F.col(c) for c in blocks.columns}, "term long, df long", total)


def lexicon(docs: DataFrame, band: Band = Band(), text_col: str = "text") -> DataFrame:
    """(term): the hashes of the band's terms."""
    n = docs.count()
    return document_frequencies(docs, max(1, math.ceil(band.low * n)), int(band.high * n), text_col).select("term")


_SALTS = (np.arange(1, N_SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
_RATE_OF = np.repeat(np.array(RATES, np.uint64), PER_RATE)[:, None]


def in_subsets(terms: np.ndarray) -> np.ndarray:
    """For each random subset of the lexicon, which of the terms are in it."""
    h = (terms.astype(np.uint64)[None, :] ^ _SALTS) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h % _RATE_OF == 0


def fingerprint(own: np.ndarray, text: str | None) -> tuple[str, ...]:
    """Signature of a text's lexicon terms (sorted), then of those in each subset; "" where a subset has no term of the text."""
    if not len(own):
        return ("0" + hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()[:31],)
    chosen = (own[member] for member in in_subsets(own))
    return (xxhash.xxh3_64_hexdigest(own.tobytes()), *(f"{xxhash.xxh3_64_intdigest(c.tobytes()) & 0xFFFFFFFF:08x}" if len(c) else "" for c in chosen))


def within(terms: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """The terms that a sorted lexicon holds."""
    if not len(lexicon):
        return terms[:0]
    at = np.minimum(np.searchsorted(lexicon, terms), len(lexicon) - 1)
    return terms[lexicon[at] == terms]


def likeness(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """1 for equal fingerprints; else the best share, over the rates, of equal signatures among subsets with a term of either."""
    if a == b:
        return 1.0
    if len(a) != len(b) or len(a) == 1:
        return 0.0
    best = 0.0
    for k in range(1, N_SUBSETS + 1, PER_RATE):
        told = [(x, y) for x, y in zip(a[k : k + PER_RATE], b[k : k + PER_RATE], strict=True) if x or y]
        best = max(best, sum(x == y for x, y in told) / (len(told) + 0.5))
    return best


def _bucket(key: Column, splits: list[tuple[int, int]]) -> Column:
    """How many of the sorted splits are at most ``key``: a binary search in SQL."""
    if not splits:
        return F.lit(0)
    step = 1 << (len(splits).bit_length() - 1)
    steps = []
    while step:
        steps.append(step)
        step //= 2
    table = F.from_json(F.lit(json.dumps([{"k": k, "h": h} for k, h in splits])), "array<struct<k:bigint,h:bigint>>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda lo, s: F.when((lo + s <= len(splits)) & (F.get(table, lo + s - 1) <= key), lo + s).otherwise(lo))


def with_next(docs: DataFrame, id_col: str, text_col: str, buckets: int | None = None) -> DataFrame:
    """Rows (b, copy, id, text), each bucket in one task and ordered by descending id and text hash, followed by a copy of the
    first row of the bucket below. One shuffle of the texts, no global sort, and one extra row per bucket.

    Buckets are ranges of (id, hash of the text) from a sample of about 50 each, so that rows that share an id, or have none,
    are spread too; that is what a range partitioning keeps on the driver as well.
    """
    spark = docs.sparkSession
    n = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(column(text_col), F.lit(""))
    key = F.struct(F.coalesce(column(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("h"))
    keys = docs.select(key.alias("key"))
    sample = sorted({(r[0]["k"], r[0]["h"]) for r in sampled(keys, "key", 50 * n).collect()})
    splits = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    heads = {r["b"]: r["key"] for r in keys.groupBy(_bucket(F.col("key"), splits).alias("b")).agg(F.max("key").alias("key")).collect()}
    order = sorted(heads)
    above = {f"{heads[b]['k']}:{heads[b]['h']}": order[(i + 1) % len(order)] for i, b in enumerate(order)}
    own = F.struct(_bucket(key, splits).alias("b"), F.lit(0).alias("copy"))
    places = F.array(own)
    if above:
        to = F.try_element_at(F.from_json(F.lit(json.dumps(above)), "map<string,int>"), F.concat_ws(":", key["k"], key["h"]))
        places = let(to, lambda b: F.when(b.isNotNull(), F.array(own, F.struct(b.alias("b"), F.lit(1).alias("copy")))).otherwise(F.array(own)))
    rows = docs.select(F.explode(places).alias("p"), column(id_col).cast("long").alias("id"), text.alias("text"), key.alias("key"))
    return rows.select("p.b", "p.copy", "key", "id", "text").repartition(n, "b").sortWithinPartitions("b", "copy", F.desc("key"), "text").select("b", "copy", "id", "text")


def _followed(batches: Iterator[dict[str, pa.Array]]) -> Iterator[tuple[Any, str, str, Any, int]]:
    """(id, text, text of the next document, its id, how many came before) for each row of ``with_next``."""
    before: tuple[int, Any, str] | None = None
    n = 0
    for b in batches:
        for bucket, copy, doc_id, scalar in zip(b["b"].to_pylist(), b["copy"].to_pylist(), b["id"].to_pylist(), b["text"], strict=True):
            text = scalar.as_py()
            if before is not None and before[0] != bucket:
                raise RuntimeError("a bucket ends without the row that follows it")
            if copy and before is None:
                continue
            if before is not None:
                yield before[1], before[2], text, doc_id, n
                n += 1
            before = None if copy else (bucket, doc_id, text)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many of the next text's first characters."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _digests(rows: Iterator[tuple[Any, int, str, tuple[str, ...], tuple[str, ...], tuple[str, ...]]]) -> Iterator[dict[str, Any]]:
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    while some := [(i, n, sha, ".".join(own), ".".join(changed), likeness(own, changed), likeness(own, after)) for i, n, sha, own, changed, after in islice(rows, 512)]:
        yield dict(zip(names, map(list, zip(*some, strict=True)), strict=True))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fingerprint_digest(docs: DataFrame, band: Band = Band(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The registered query: each text, its edited text and its next document."""
    terms = cut_lineage(lexicon(docs, band, text_col))
    ordered = with_next(docs, id_col, text_col)
    columns = {c: F.col(c) for c in ("b", "copy", "id", "text")}
    if terms.count() > band.most_terms:
        return _joined_digest(ordered, columns, terms)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(terms.toPandas()["term"].to_numpy(np.int64)))

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        known = shared.value
        make = lambda text: fingerprint(within(terms_of(text), known), text)

        def rows() -> Iterator[tuple]:
            last: tuple[str, tuple[str, ...]] | None = None
            for doc_id, text, following, _, _ in _followed(batches):
                own = last[1] if last and last[0] is text else make(text)
                after, changed = make(following), edited(text, following)
                last = following, after
                yield doc_id, len(text), _sha(changed), own, make(changed), after

        return _digests(rows())

    return map_batches(ordered, columns, _DIGEST, run)


def _joined_digest(ordered: DataFrame, columns: dict[str, Column], lexicon: DataFrame) -> DataFrame:
    """The same for a lexicon of any size: the terms of all texts are joined with it, and come back to their texts."""

    def listed(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        for doc_id, text, following, _, n in _followed(batches):
            changed = edited(text, following)
            words = [terms_of(t) for t in (text, changed, following)]
            row = {"n": [n], "doc_id": [doc_id], "n_chars": [len(text)], "edited": [_sha(changed)], "digests": [[fingerprint(w[:0], t)[0] for w, t in zip(words, (text, changed, following), strict=True)]]}
            yield row | {"terms": [[x.tolist() for x in words]]}

    kinds = "n long, doc_id long, n_chars long, edited string, digests array<string>"
    texts = cut_lineage(map_batches(ordered, columns, f"{kinds}, terms array<array<long>>", listed).withColumn("n", F.monotonically_increasing_id()))
    entries = texts.select("n", F.posexplode("terms").alias("which", "own")).select("n", "which", F.explode("own").alias("term"))
    found = join_hot(entries, lexicon, ["term"], "inner", "n", entries.count()).groupBy("n", "which").agg(F.collect_list("term").alias("own"))
    by_text = found.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("which", "own"))).alias("own"))
    own = lambda k: F.coalesce(F.try_element_at("own", F.lit(k)), F.array().cast("array<bigint>"))
    all_rows = texts.drop("terms").join(by_text, "n", "left").select(*(x.split()[0] for x in kinds.split(", ")), F.array(own(0), own(1), own(2)).alias("own"))

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc_id, n_chars, sha, digests, own in zip(*(b[c].to_pylist() for c in ("doc_id", "n_chars", "edited", "digests", "own")), strict=True):
                    terms = [np.sort(np.array(x, np.int64)) for x in own]
                    yield doc_id, n_chars, sha, *(fingerprint(t, None) if len(t) else (d,) for t, d in zip(terms, digests, strict=True))

        return _digests(rows())

    return map_batches(all_rows, {c: F.col(c) for c in all_rows.columns}, _DIGEST, run)
