"""Near-duplicates by Order MinHash.

A document is the sequence of its occurrence-labelled k-mers of words. Each
sketch takes the few k-mers that are smallest under its own hash and keeps them
in text order, so two documents agree where they share k-mers in the same order.
Documents that agree in a sketch are candidates; candidates are verified by a
banded alignment of the two sequences, and verified links make classes.

Links are sought in two rounds, each without listing the pairs of a bucket: first
with the leader of a bucket, then among all that agree and are still in different
classes. Buckets of any size are ranges of a sorted table, cut into blocks; the last
round compares every two blocks of a bucket, unless both hold one and the same class
only. Blocks carry the sequences, so that a task aligns what it compares and only
links leave it, of them no more than join the classes that it sees.

Defined results: null and empty texts equal each other; a text of fewer than k
words is one k-mer; exact copies are one text and always share a class; repeated
rows are copies; the class id is the smallest id of the class (nulls aside), and
the hash of its first text where no member has an id; an empty table gives an
empty result; other columns are ignored. Texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm import repeats
from gossamer.llm.common import column, fresh, join_hot, map_batches
from gossamer.llm.rolling import window_hashes, word_hashes
from gossamer.session import cut_lineage, release


@dataclass(frozen=True)
class Rules:
    """``k`` words a k-mer; ``sketches`` of ``ordered`` k-mers each; ``similarity`` links.

    Pairs that agree in a sketch are aligned unless an estimate from ``BINS`` further minima
    says, by ``sigmas`` standard deviations, that they cannot reach the similarity: by the
    hypergeometric tail it loses less than one in a million links at exactly 0.8, fewer than the sketches.
    """

    k: int = 5
    sketches: int = 16
    ordered: int = 3
    similarity: float = 0.8
    sigmas: float = 5.0
    block: int = 512
    cell: int = 16


_ROUNDING = 1e-6  # far over the rounding of a bound, far under the step between counts
BINS = 256
_EMPTY = 255


_MIX = np.uint64(0xD6E8FEB86659FD93)


def kmers(text: bytes | None, k: int) -> np.ndarray:
    """Occurrence-labelled k-mers in text order, as 64-bit hashes; all differ within a document."""
    words = (text or b"").split()
    h = window_hashes(word_hashes(words), min(k, max(1, len(words))))
    if len(h) < 2:
        return h if len(h) else np.zeros(1, np.uint64)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    starts = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    out = np.empty_like(h)
    out[order] = (s + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * _MIX
    return out


def sketch(labelled: np.ndarray, rules: Rules) -> np.ndarray:
    """One 64-bit hash per sketch: its smallest k-mers, in text order."""
    take = min(rules.ordered, len(labelled))
    seeds = (np.arange(1, rules.sketches + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    out = np.zeros(rules.sketches, np.uint64)
    for lo in range(0, rules.sketches, 4):
        mixed = labelled[None, :] * seeds[lo : lo + 4, None]
        mixed ^= mixed >> np.uint64(31)
        mixed *= _MIX
        at = np.sort(np.argpartition(mixed, take - 1, axis=1)[:, :take], axis=1) if take < len(labelled) else np.tile(np.arange(take), (len(mixed), 1))
        for i in range(take):
            out[lo : lo + 4] = (out[lo : lo + 4] ^ labelled[at[:, i]]) * _MIX + np.uint64(i + 1)
    out = (out ^ seeds) * _MIX
    return out ^ (out >> np.uint64(32))


def bins(labelled: np.ndarray) -> np.ndarray:
    """One byte of the smallest k-mer in each of the bins that one hash deals them into; 255 where a bin has none."""
    h = np.sort((labelled ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x9E3779B97F4A7C15))
    cuts = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(56))
    has = np.diff(np.append(cuts, len(h))) > 0
    low = h[np.minimum(cuts, len(h) - 1)]
    low ^= low >> np.uint64(23)
    return np.where(has, (low * _MIX >> np.uint64(40)) % np.uint64(_EMPTY), _EMPTY).astype(np.uint8)


def may_link(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, rules: Rules) -> np.ndarray:
    """For all pairs of rows of bins: whether their estimated share of common k-mers leaves the similarity possible.

    Each bin that either has draws one k-mer of the union without replacement, so the
    estimate's variance falls to nothing as the bins come to hold all of a short text.
    """
    equal = np.zeros((len(x), len(y)), np.int32)
    for j in range(BINS):
        equal += x[:, j, None] == y[None, :, j]
    fx, fy = (x != _EMPTY).astype(np.float32), (y != _EMPTY).astype(np.float32)
    either = fx.sum(1)[:, None] + fy.sum(1)[None, :] - fx @ fy.T
    agreed = equal - (BINS - either)
    p = rules.similarity
    union = np.maximum((nx[:, None] + ny[None, :]) / (1 + p), 2)  # at most, for pairs that reach the similarity
    left = np.clip((union - either) / (union - 1), 0, 1)
    return agreed >= p * either - rules.sigmas * np.sqrt(p * (1 - p) * either * left) - 1


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """m / (len(a) + len(b) - m) for the longest common subsequence m of two labelled sequences, within a band.

    Labels are unique within a document, so the alignment is a longest increasing
    chain of matches. The band is as wide as any alignment that reaches ``least`` may drift.
    """
    na, nb = len(a), len(b)
    if min(na, nb) < least * max(na, nb) - _ROUNDING:
        return 0.0
    order = np.argsort(b)
    where = np.searchsorted(b[order], a)
    where[where == nb] = 0
    at = order[where]
    hit = b[at] == a
    band = int(max(na, nb) * (1 - least) + _ROUNDING) + 1
    hit &= np.abs(at - np.arange(na)) <= band
    at = at[hit]
    if len(at) < least * (na + nb) / (1 + least) - _ROUNDING:
        return 0.0
    if (at[1:] > at[:-1]).all():
        m = len(at)
    else:
        tails: list[int] = []
        for x in at.tolist():
            i = bisect_left(tails, x)
            if i == len(tails):
                tails.append(x)
            else:
                tails[i] = x
        m = len(tails)
    return m / (na + nb - m)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(column(text_col), F.lit(""))
    return docs.select(column(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))


def _shared_bands(texts: DataFrame, rules: Rules) -> DataFrame:
    """(t, sk, bins, runs): texts with a sketch that another text has too, and which of their sketches (as runs) these are."""

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        for b in batches:
            seen: dict[int, tuple[bytes, bytes]] = {}
            for t, text in zip(b["t"].to_pylist(), b["text"], strict=True):
                if t not in seen:
                    labelled = kmers(text.as_py(), rules.k)
                    seen[t] = sketch(labelled, rules).tobytes(), bins(labelled).tobytes() + np.uint32(len(labelled)).tobytes()
            yield {"t": list(seen), "sk": [x[0] for x in seen.values()], "bins": [x[1] for x in seen.values()]}

    sketches = map_batches(texts, {c: F.col(c) for c in ("t", "text")}, "t long, sk binary, bins binary", run).dropDuplicates(["t"])
    bands = np.arange(rules.sketches)

    def entries(r: dict[str, Any]) -> Iterator[repeats.Entry]:
        yield np.frombuffer(r["sk"], np.uint64), None, r["t"], 0, bands

    sketches = cut_lineage(sketches)
    ranges = repeats.Ranges.over(texts, sketches.count() * rules.sketches)
    found = repeats.find(repeats.send(sketches, {c: F.col(c) for c in ("t", "sk")}, entries, ranges), ranges)
    return cut_lineage(sketches.join(found.select(F.col("k").alias("t"), "runs").hint("shuffle_hash"), "t"))


def _bucket_rows(shared: DataFrame, rules: Rules) -> DataFrame:
    """(key, j, other, t, body): one row for each shared sketch j; ``other`` orders a bucket by the next sketch, so that like texts are near.

    The body holds four bytes of every sketch, then the bins and the number of k-mers.
    """

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        for b in batches:
            key, at, other, ts, bodies = [], [], [], [], []
            for t, sk, own, runs in zip(b["t"].to_pylist(), b["sk"], b["bins"], b["runs"], strict=True):
                full = np.frombuffer(sk.as_py(), np.uint64)
                body = (full >> np.uint64(32)).astype(np.uint32).tobytes() + own.as_py()
                r = runs.as_py()
                for j in (j for x, y in zip(r[::2], r[1::2], strict=True) for j in range(x, y)):
                    key.append(int(full[j].view(np.int64)))
                    at.append(j)
                    other.append(int(full[(j + 1) % rules.sketches] >> np.uint64(33)))
                    ts.append(t)
                    bodies.append(body)
            yield {"key": key, "j": at, "other": other, "t": ts, "body": bodies}

    return map_batches(shared, {c: F.col(c) for c in ("t", "sk", "bins", "runs")}, "key long, j int, other int, t long, body binary", run)


def _bodies(bodies: list[bytes], rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sketches, bins, numbers of k-mers) of some rows."""
    at = 4 * rules.sketches
    raw = np.frombuffer(b"".join(bodies), np.uint8).reshape(len(bodies), at + BINS + 4)
    return np.ascontiguousarray(raw[:, :at]).view(np.uint32), raw[:, at : at + BINS], np.ascontiguousarray(raw[:, at + BINS :]).view(np.uint32)[:, 0].astype(np.float64)


def _leader_pairs(rows: DataFrame, rules: Rules) -> DataFrame:
    """(a, b): each text with the first of its bucket, if they may link. ``rows`` has key, other, t and body."""

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        def pairs_of(block: list[tuple]) -> Iterator[tuple[int, int]]:
            t = np.array([r[1] for r in block])
            if len(t) > 1:
                _, own, n = _bodies([r[2] for r in block], rules)
                first = int(np.argmin(t))
                ok = may_link(own[first : first + 1], n[first : first + 1], own, n, rules)[0] & (t != t[first])
                yield from ((int(t[first]), x) for x in t[ok].tolist())

        key_now, block, out = None, [], set()
        for b in batches:
            for row in zip(*(b[n].to_pylist() for n in ("key", "t", "body")), strict=True):
                if row[0] != key_now or len(block) >= rules.block:
                    out.update((min(p), max(p)) for p in pairs_of(block))
                    # the first of a long bucket meets every block of it
                    carry = None if row[0] != key_now else min(block, key=lambda r: r[1])
                    key_now, block = row[0], [carry] if carry else []
                block.append(row)
            if len(out) > 50_000:
                yield {"a": [p[0] for p in out], "b": [p[1] for p in out]}
                out = set()
        out.update((min(p), max(p)) for p in pairs_of(block))
        if out:
            yield {"a": [p[0] for p in out], "b": [p[1] for p in out]}

    ordered = rows.repartitionByRange("key", "other", "t").sortWithinPartitions("key", "other", "t")
    return map_batches(ordered, {n: F.col(n) for n in ("key", "t", "body")}, "a long, b long", run).distinct()


_MEMBER = np.dtype([("t", np.int64), ("c", np.int64), ("n", np.int32)])


class _Block:
    """Texts of a bucket: members (text, class, number of k-mers), what ``_bodies`` tells of them, and their sequences."""

    def __init__(self, raw: bytes, n: int, rules: Rules) -> None:
        width, size = 4 * rules.sketches + BINS + 4, n * _MEMBER.itemsize
        self.members = np.frombuffer(raw[:size], _MEMBER)
        self.sketches, self.bins, self.n = _bodies([raw[size + i * width : size + (i + 1) * width] for i in range(n)], rules)
        self.sequences = np.frombuffer(raw[size + n * width :], np.uint32)
        self.cuts = np.concatenate(([0], np.cumsum(self.members["n"], dtype=np.int64)))

    def sequence(self, i: int) -> np.ndarray:
        return self.sequences[self.cuts[i] : self.cuts[i + 1]]

    @staticmethod
    def pack(rows: list[tuple[int, int, bytes, bytes]]) -> bytes:
        """Of rows (text, class, body, sequence)."""
        members = np.array([(t, c, len(seq) // 4) for t, c, _, seq in rows], _MEMBER)
        return members.tobytes() + b"".join(r[2] for r in rows) + b"".join(r[3] for r in rows)


class _Classes(dict):
    """Classes that links of this task have joined: class -> a class of the same set."""

    def __missing__(self, c: int) -> int:
        return c

    def root(self, c: int) -> int:
        while (up := self[c]) != c:
            self[c] = c = self[up]
        return c


_BLOCK_BYTES = 400_000


def _remaining_links(rows: DataFrame, sequences: DataFrame, rules: Rules) -> DataFrame:
    """(a, b): links between texts that share a bucket and are in different classes, as many as join the classes of each task.

    ``rows`` has key, j, t, body and c (the class so far). Only buckets of several classes are looked at. Sorted by class, a bucket
    becomes blocks that mostly hold one class; two such blocks of the same class are never compared, so that what is left
    follows the number of texts outside the bucket's large class. A pair is judged in the first bucket it shares. The blocks of
    a long bucket are dealt to a square of cells, one task each, of about ``rules.cell`` blocks a side.
    """

    def cut(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        block: list[tuple] = []
        size = 0

        def done() -> dict[str, Any]:
            c = [r[2] for r in block]
            return {"key": [block[0][0]], "j": [block[0][5]], "first": [block[0][1]], "low": [min(c)], "high": [max(c)], "n": [len(block)], "body": [_Block.pack([r[1:5] for r in block])]}

        for b in batches:
            for row in zip(*(b[n].to_pylist() for n in ("key", "t", "c", "body", "seq", "j")), strict=True):
                if block and (row[0] != block[0][0] or len(block) >= rules.block or size >= _BLOCK_BYTES):
                    yield done()
                    block, size = [], 0
                block.append(row)
                size += len(row[3]) + len(row[4])
        if block:
            yield done()

    def compare(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        known = _Classes()
        for b in batches:
            for j, n1, n2, same, raw1, raw2 in zip(*(b[n].to_pylist() for n in ("j", "n1", "n2", "same")), b["x"], b["y"], strict=True):
                x, y = _Block(raw1.as_py(), n1, rules), _Block(raw2.as_py(), n2, rules)
                ok = may_link(x.bins, x.n, y.bins, y.n, rules) & (x.members["c"][:, None] != y.members["c"][None, :])
                for earlier in range(j):
                    ok &= x.sketches[:, earlier, None] != y.sketches[None, :, earlier]
                if same:
                    ok = np.triu(ok, 1)
                links = []
                for p, q in zip(*(at.tolist() for at in np.nonzero(ok)), strict=True):
                    a, c = known.root(int(x.members["c"][p])), known.root(int(y.members["c"][q]))
                    if a != c and aligned_similarity(x.sequence(p), y.sequence(q), rules.similarity) >= rules.similarity:
                        known[max(a, c)] = min(a, c)
                        links.append((int(x.members["t"][p]), int(y.members["t"][q])))
                if links:
                    yield {"a": [min(l) for l in links], "b": [max(l) for l in links]}
                if len(known) > 1_000_000:
                    known.clear()

    mixed = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    wanted = join_hot(rows, mixed, ["key"], "inner", "t", rows.count()).join(sequences, "t")
    ordered = wanted.repartitionByRange("key", "c", "t").sortWithinPartitions("key", "c", "t")
    blocks = cut_lineage(map_batches(ordered, {n: F.col(n) for n in ("key", "t", "c", "body", "seq", "j")}, "key long, j int, first long, low long, high long, n int, body binary", cut))
    sides = blocks.groupBy("key", "j").agg(F.ceil(F.count(F.lit(1)) / rules.cell).cast("int").alias("sides"))
    placed = join_hot(blocks, sides, ["key", "j"], "inner", "first", blocks.count())
    own, all_sides = F.pmod(F.xxhash64("first"), F.col("sides")).cast("int"), F.sequence(F.lit(0), F.col("sides") - 1)
    cells = lambda across: F.explode(F.transform(all_sides, lambda x: F.struct((x if across else own).alias("a"), (own if across else x).alias("b"))))
    left, right = (placed.select("*", cells(across).alias("cell")).alias(name) for name, across in (("l", False), ("r", True)))
    several = (F.col("l.low") != F.col("l.high")) | (F.col("r.low") != F.col("r.high")) | (F.col("l.low") != F.col("r.low"))
    same_cell = (F.col("l.key") == F.col("r.key")) & (F.col("l.j") == F.col("r.j")) & (F.col("l.cell.a") == F.col("r.cell.a")) & (F.col("l.cell.b") == F.col("r.cell.b"))
    both = left.join(right, same_cell & (F.col("l.first") <= F.col("r.first")) & several)
    columns = {"j": F.col("l.j"), "n1": F.col("l.n"), "n2": F.col("r.n"), "same": F.col("l.first") == F.col("r.first"), "x": F.col("l.body"), "y": F.col("r.body")}
    return map_batches(both, columns, "a long, b long", compare)


def _verified(pairs: DataFrame, sequences: DataFrame, rules: Rules) -> DataFrame:
    """The pairs whose alignment reaches the similarity. One side's sequences travel with the pairs, the other's once each,
    and some times more for a text in very many pairs."""

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        for batch in batches:
            a, b = [], []
            for ta, tb, x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["x"], batch["y"], strict=True):
                if aligned_similarity(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32), rules.similarity) >= rules.similarity:
                    a.append(ta)
                    b.append(tb)
            yield {"a": a, "b": b}

    n = pairs.count()
    right = join_hot(pairs, sequences.select(F.col("t").alias("b"), F.col("seq").alias("y")), ["b"], "inner", "a", n)
    # which keys are frequent is read from the pairs alone, so that the sequences of one side are not made twice
    both = join_hot(right, sequences.select(F.col("t").alias("a"), F.col("seq").alias("x")), ["a"], "inner", "b", n, pairs)
    return map_batches(both, {n: F.col(n) for n in ("a", "b", "x", "y")}, "a long, b long", run)


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(t, c): the class of each vertex, as the struct of its smallest member, with t. ``labels`` may hold classes known before.

    Smallest labels spread along the edges and by pointer jumping, so that the
    rounds grow with the logarithm of a chain's length; nothing is collected. Files
    of earlier rounds are released as soon as a round is checkpointed.
    """
    n = labels.count()
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    # edges come in as many small parts as the tasks that found them
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = cut_lineage(edges.coalesce(parts).select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("e")).select("e.u", "e.v"))
    while True:
        near = both.join(labels.select(F.col("t").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = cut_lineage(labels.join(near, labels["t"] == near["u"], "left").select("t", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c")))
        jumped = join_hot(step.withColumn("p", F.col("c.t")), step.select(F.col("t").alias("p"), F.col("c").alias("pc")), ["p"], "left", "t", n)
        labels = cut_lineage(jumped.select("t", "old", F.least("c", F.coalesce("pc", "c")).alias("c")))
        moved = labels.where(F.col("old") != F.col("c")).limit(1).count()
        labels = labels.select("t", "c")
        del near, step, jumped
        release(labels.sparkSession)
        if not moved:
            return labels


def classes(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, class_id, first): one row per document; ``first`` is the text of the class that stays, with id or, in a class without ids, without."""
    texts = _texts(docs, id_col, text_col)
    shared = _shared_bands(texts, rules)
    ids = texts.select("id", "t")
    first = ids.groupBy("t").agg(F.min("id").alias("id"))

    def sequence(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        for b in batches:
            yield {"t": b["t"], "seq": [(kmers(x.as_py(), rules.k) >> np.uint64(32)).astype(np.uint32).tobytes() for x in b["text"]]}

    # of exact copies each task sends one
    needed = texts.select("t", "text").dropDuplicates(["t"]).join(shared.select("t").hint("shuffle_hash"), "t", "left_semi")
    sequences = cut_lineage(map_batches(needed, {c: F.col(c) for c in ("t", "text")}, "t long, seq binary", sequence))
    rows = cut_lineage(_bucket_rows(shared, rules))
    label = F.struct(F.col("id").isNull().alias("none"), "id", "t")  # nulls last
    labels = cut_lineage(shared.select("t").join(first, "t").select("t", label.alias("c")))
    release(docs.sparkSession)
    edges = cut_lineage(_verified(cut_lineage(_leader_pairs(rows, rules)), sequences, rules))
    release(docs.sparkSession)
    labels = components(labels, edges) if not edges.isEmpty() else labels
    classed = cut_lineage(rows.drop("other").join(labels.select("t", F.xxhash64("c.id", "c.t").alias("c")), "t"))
    more = cut_lineage(_remaining_links(classed, sequences, rules))
    del classed
    release(docs.sparkSession)
    if not more.isEmpty():
        labels = components(labels, edges.unionByName(more))
    found = first.join(labels, "t", "left").select("t", F.coalesce("c", label).alias("c"))
    told = join_hot(ids, found, ["t"], "inner", "id", docs.count())
    return told.select("id", "t", F.coalesce("c.id", "c.t").alias("class_id"), (F.col("id").eqNullSafe(F.col("c.id")) & (F.col("t") == F.col("c.t"))).alias("first"))


def class_digest(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The registered query: one row per document with its class."""
    return classes(docs, rules).select(F.col("id").alias("doc_id"), "class_id", F.col("first").alias("is_first"))


def first_of_each(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the near-copies: of each class the one with the smallest id stays, of repeated rows one."""
    # repeated rows go before the shuffle; its two keys serve their removal and the join, so that texts are shuffled once here
    k, h = fresh(docs.columns, "__k"), fresh(docs.columns, "__h")
    key = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    firsts = classes(docs, rules, id_col, text_col).where("first").select(key(F.col("id")).alias(k), F.col("t").alias(h)).distinct()
    marked = docs.withColumns({k: key(column(id_col).cast("long")), h: F.xxhash64(F.coalesce(column(text_col), F.lit("")))}).dropDuplicates([k, h])
    return marked.join(firsts.hint("shuffle_hash"), [k, h], "left_semi").select(*(column(c) for c in docs.columns))
