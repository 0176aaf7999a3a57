"""Benchmark decontamination by template canonicalisation.

Numbers (in digits or words), names and units become typed placeholders; windows of the resulting
templates are hashed and joined with the windows of the benchmark's items; what
stands in the placeholders is then checked both ways: an item's value must always be
replaced by the same value within one occurrence, and a value of the text must always replace the same,
so that re-parameterised questions are caught and chance matches are not. A text that holds an item several
times, with other values, is judged by its best occurrence.

The join: a bit table of the items' windows, of fixed size, lets few windows of the documents through; these are
joined with the items' windows. Windows that many items share are left out of the join where enough others stay
that no document with half of an item's windows can be missed. Then each pair of a document and an item is judged on its texts.

Defined results: null and empty texts match nothing, as do null and empty items;
repeated rows are each reported; an item shorter than the window is matched
whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gossamer.llm.common import Memo, column, fresh, join_hot, map_batches, struct_type, type_of
from gossamer.llm.rolling import window_hashes
from gossamer.session import cut_lineage

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:\n]")
_UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet g kg mg lb lbs oz pound pounds gram grams ton tons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years l ml liter liters litre litres "
    "gallon gallons percent dollar dollars euro euros cent cents degree degrees watt watts volt volts mph kmh hz kb mb gb".split()
)
_NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
_WORD, _NUMBER, _UNIT, _TITLE, _BREAK = range(5)
_PLACE = np.array([0, 0xA1B2C3D4E5F60711, 0xB2C3D4E5F6071122, 0xC3D4E5F607112233, 0], np.uint64)


def _code(token: str) -> int:
    """Hash of a token's lower-case form with its class in the lowest three bits."""
    c = token[0]
    low = token.lower()
    kind = _NUMBER if c.isdigit() or low in _NUMBERS else _BREAK if c in ".!?:\n" else _UNIT if low in _UNITS else _TITLE if c.isupper() and not token[1:].isupper() and len(token) > 1 else _WORD
    return (xxhash.xxh3_64_intdigest(low) & ~7) | kind


_CODES = Memo(_code, 250_000)


def template(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template codes, surface codes and placeholder flags of a text's tokens.

    A capitalised word is a name unless a sentence starts there; a unit counts after a number only.
    """
    codes = np.fromiter(map(_CODES.__getitem__, _TOKEN.findall(text or "")), np.uint64)
    kind = (codes & np.uint64(7)).astype(np.int64)
    before = np.concatenate(([_BREAK], kind[:-1])) if len(kind) else kind
    kind = np.where((kind == _TITLE) & (before == _BREAK) | (kind == _UNIT) & (before != _NUMBER), _WORD, kind)
    surface = codes & ~np.uint64(7)
    slot = (kind == _NUMBER) | (kind == _UNIT) | (kind == _TITLE)
    kept = kind != _BREAK
    return np.where(slot, _PLACE[kind], surface)[kept], surface[kept], slot[kept]


def merged(codes: np.ndarray, surface: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with one placeholder, whose value is the whole run, for each run of name tokens and each run of numbers with its unit."""
    inner = slot & (codes == _PLACE[_UNIT])
    for kind in (_TITLE, _NUMBER):
        own = slot & (codes == _PLACE[kind])
        inner[1:] |= own[1:] & own[:-1]
    if not inner.any():
        return codes, surface, slot
    at = np.flatnonzero(~inner)
    nth = np.arange(len(codes)) - at[np.cumsum(~inner) - 1]
    run = np.add.reduceat((surface ^ nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93), at)
    size = np.diff(np.append(at, len(codes)))
    return codes[at], np.where(size > 1, run, surface[at]), slot[at]


@dataclass(frozen=True)
class Rules:
    """Windows of ``window`` tokens with ``literal`` or more words that are no placeholders; ``coverage`` of an item's
    windows must occur, and ``consistent`` of the placeholders' values must agree with the usual replacement, both ways.
    A window is common if more than ``common`` items have it; ``bits``, 15 or more, sizes the bit table (2**26: 8 MB);
    up to ``most_keys`` keys of documents (16 bytes each) are broadcast, more are joined."""

    window: int = 8
    literal: int = 4
    coverage: float = 0.5
    consistent: float = 0.8
    common: int = 50
    bits: int = 26
    most_keys: int = 200_000


@dataclass(frozen=True)
class Form:
    """An item token by token, or (``runs``) with runs of names, and numbers with units, as one placeholder each, so that
    values of another length match too. ``hashes`` are its windows with enough literal words, ``at`` their positions."""

    runs: bool
    w: int
    hashes: np.ndarray
    at: np.ndarray
    surface: np.ndarray
    slot: np.ndarray

    def least(self, coverage: float) -> int:
        """How many windows must occur."""
        return max(1, math.ceil(coverage * len(self.hashes) - 1e-9))


def forms_of(text: str | None, rules: Rules) -> list[Form]:
    """The one or two forms of an item; the second is left out where it has no window with enough literal words."""
    plain, out = template(text), []
    if not len(plain[0]):
        return out
    for runs in (False, True) if plain[2].any() else (False,):
        codes, surface, slot = merged(*plain) if runs else plain
        w = min(rules.window, len(codes))
        h = window_hashes(codes, w)
        literal = w - np.convolve(slot, np.ones(w, int), "valid")
        good = np.flatnonzero(literal >= (rules.literal if runs else min(rules.literal, w)))
        if not len(good):
            if runs:
                continue
            good = np.arange(len(h))
        out.append(Form(runs, w, h[good], good, surface, slot))
    return out


def matched(forms: list[Form], plain: tuple[np.ndarray, ...], joined: tuple[np.ndarray, ...], rules: Rules) -> tuple[int, int, float, bool] | None:
    """(windows found, item's windows, agreement of placeholders, whether any value was replaced), of the best occurrence in a text."""
    best: tuple | None = None
    for form in forms:
        codes, surface, _ = joined if form.runs else plain
        h = window_hashes(codes, form.w)
        order = np.argsort(form.hashes, kind="stable")
        known = form.hashes[order]
        here = np.flatnonzero(np.isin(h, known))
        lo, hi = np.searchsorted(known, h[here], "left"), np.searchsorted(known, h[here], "right")
        pairs = [(p, int(form.at[order[e]])) for p, a, b in zip(here.tolist(), lo.tolist(), hi.tolist(), strict=True) for e in range(a, b)]
        n, least = len(form.hashes), form.least(rules.coverage)
        if len({q for _, q in pairs}) < least:
            continue
        for hits in _occurrences(pairs, len(form.surface), least):
            hit, agreed, same = _judged(hits, form.surface, form.slot, surface, form.w)
            rank = (agreed >= rules.consistent, hit / n, agreed, same, not form.runs)
            if best is None or rank > best[0]:
                best = rank, (hit, n, agreed, not same)
    return best and best[1]


class Index:
    """Some items at hand, for texts one by one."""

    def __init__(self, items: list[tuple[Any, str | None]], rules: Rules) -> None:
        self.items = [(item_id, forms) for item_id, text in items if (forms := forms_of(text, rules))]

    def matches(self, text: str | None, rules: Rules) -> Iterator[tuple[Any, int, int, float, bool]]:
        plain = template(text)
        joined = merged(*plain)
        for item_id, forms in self.items:
            if found := matched(forms, plain, joined, rules):
                yield item_id, *found


def _occurrences(pairs: list[tuple[int, int]], length: int, least: float) -> Iterator[list[tuple[int, int]]]:
    """Sets of (window of the text, window of the item) that hold ``least`` windows of the item or more.

    These are the hits of each alignment (equal distance of the two positions); each
    alignment with hits of others, in order, where words were put in or left out; and all hits together.
    """
    by_shift: dict[int, list[tuple[int, int]]] = {}
    for p, q in pairs:
        by_shift.setdefault(p - q, []).append((p, q))
    yield pairs
    if len(by_shift) == 1:
        return
    shifts = sorted(by_shift)
    for shift, own in by_shift.items():
        if len(own) >= least:
            yield own
        near = [s for s in shifts[bisect_left(shifts, shift - length) : bisect_right(shifts, shift + length)] if s != shift]
        if not near or len({q for s in (shift, *near) for _, q in by_shift[s]}) < least:
            continue
        chain = sorted(own)
        for s in sorted(near, key=lambda s: (abs(s - shift), s)):
            for p, q in by_shift[s]:
                i = bisect_left(chain, (p, q))
                if (i == 0 or chain[i - 1][0] < p and chain[i - 1][1] < q) and (i == len(chain) or p < chain[i][0] and q < chain[i][1]):
                    chain.insert(i, (p, q))
        if len(chain) > len(own) and len(chain) >= least:
            yield chain


def _judged(hits: list[tuple[int, int]], values: np.ndarray, slot: np.ndarray, surface: np.ndarray, w: int) -> tuple[int, float, bool]:
    """(the item's windows among the hits, agreement of their placeholders, whether all values stayed)."""
    pairs = [(int(values[j]), int(surface[i])) for i, j in {(p + d, q + d) for p, q in hits for d in range(w) if slot[q + d]}]
    agreed = 1.0
    for way in (0, 1) if pairs else ():
        seen: dict[int, Counter] = {}
        for pair in pairs:
            seen.setdefault(pair[way], Counter())[pair[1 - way]] += 1
        agreed = min(agreed, sum(max(c.values()) for c in seen.values()) / len(pairs))
    return len({q for _, q in hits}), agreed, all(a == b for a, b in pairs)


def _form_hash(h: np.ndarray, runs: bool, w: int) -> np.ndarray:
    """Windows of different forms and lengths are never equal."""
    return (h ^ np.uint64(2 * w + runs)) * np.uint64(0x9E3779B97F4A7C15)


def _item_windows(items: DataFrame, rules: Rules) -> DataFrame:
    """(item, runs, w, n, hash): the distinct windows of each form of each item."""

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        for b in batches:
            for item, text in zip(b["item"].to_pylist(), b["text"], strict=True):
                for f in forms_of(text.as_py(), rules):
                    h = np.unique(_form_hash(f.hashes, f.runs, f.w)).view(np.int64)
                    yield {"item": [item] * len(h), "runs": [f.runs] * len(h), "w": [f.w] * len(h), "need": [max(1, f.least(rules.coverage) - (len(f.hashes) - len(h)))] * len(h), "hash": h}

    return map_batches(items, {c: F.col(c) for c in ("item", "text")}, "item long, runs boolean, w int, need int, hash long", run)


def _joined_windows(windows: DataFrame, rules: Rules) -> DataFrame:
    """(item, runs, need, hash): the windows that take part in the join, and how many of them a document must have.

    Of the windows of a form, ``need`` must occur. Leaving out d of them (d below ``need``) leaves ``need`` - d.
    """
    shared = windows.join(windows.groupBy("hash").agg(F.count(F.lit(1)).alias("items")), "hash")
    rank = F.row_number().over(Window.partitionBy("item", "runs").orderBy(F.desc("items"), "hash"))
    ranked = shared.withColumn("out", (F.col("items") > rules.common) & (rank < F.col("need")))
    left_out = F.count_if("out").over(Window.partitionBy("item", "runs"))
    return ranked.withColumn("need", (F.col("need") - left_out).cast("int")).where(~F.col("out")).select("item", "runs", "need", "hash")


_CHUNK = 15


def _bit_table(windows: DataFrame, rules: Rules) -> np.ndarray:
    """One bit for the first ``rules.bits`` bits of each hash; made in chunks by the executors, so its size is all that the driver gets."""
    place = F.shiftrightunsigned("hash", 64 - rules.bits)
    places = windows.select(place.alias("at"), F.shiftright(place, _CHUNK).cast("int").alias("chunk")).distinct()

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        now, bits = None, np.zeros(1 << _CHUNK, bool)
        for b in batches:
            chunk, at = b["chunk"].to_numpy(), b["at"].to_numpy() & ((1 << _CHUNK) - 1)
            for c in np.unique(chunk).tolist():
                if now is not None and c != now:
                    yield {"chunk": [now], "bits": [np.packbits(bits).tobytes()]}
                    bits[:] = False
                now = c
                bits[at[chunk == c]] = True
        if now is not None:
            yield {"chunk": [now], "bits": [np.packbits(bits).tobytes()]}

    ordered = places.repartition("chunk").sortWithinPartitions("chunk")
    table = np.zeros(1 << (rules.bits - 3), np.uint8)
    size = 1 << (_CHUNK - 3)
    for r in map_batches(ordered, {c: F.col(c) for c in ("chunk", "at")}, "chunk int, bits binary", run).toLocalIterator():
        table[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return table


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Repeated rows share a key; rows that share an id do not."""
    return [F.xxhash64(column(id_col).isNull(), column(id_col)).alias("k"), F.xxhash64(column(text_col), F.lit(7)).alias("h")]


def _hit_rows(docs: DataFrame, windows: DataFrame, rules: Rules, id_col: str, text_col: str) -> DataFrame:
    """(r, k, h, id, text, hits): the documents with windows that the bit table lets through, and these windows' hashes."""
    shared = docs.sparkSession.sparkContext.broadcast((_bit_table(windows, rules), [(r["runs"], r["w"]) for r in windows.select("runs", "w").distinct().collect()]))
    shift, seven = np.uint64(64 - rules.bits), np.uint64(7)

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        table, forms = shared.value
        for b in batches:
            rows: list[int] = []
            hits: list[list[int]] = []
            for i, text in enumerate(b["text"]):
                plain = template(text.as_py())
                joined = merged(*plain) if any(runs for runs, _ in forms) else plain
                found = []
                for runs, w in forms:
                    h = _form_hash(window_hashes((joined if runs else plain)[0], w), runs, w)
                    at = h >> shift
                    found.append(h[(table[at >> np.uint64(3)] << (at & seven).astype(np.uint8)) & 128 != 0])
                own = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
                if len(own):
                    rows.append(i)
                    hits.append(own.view(np.int64).tolist())
            if rows:
                take = pa.array(rows, pa.int64())
                yield {c: b[c].take(take) for c in ("k", "h", "id", "text")} | {"hits": hits}

    output = StructType([*struct_type("k long, h long"), StructField("id", type_of(docs, id_col)), *struct_type("text string, hits array<long>")])
    k, h = _keys(id_col, text_col)
    rows = map_batches(docs, {"k": k, "h": h, "id": column(id_col), "text": column(text_col)}, output, run)
    return cut_lineage(rows.withColumn("r", F.monotonically_increasing_id()))


def _matches(docs: DataFrame, benchmark: DataFrame, rules: Rules, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(k, h, id, item_id, windows_found, item_windows, agreement, replaced)."""
    items = cut_lineage(benchmark.select(F.monotonically_increasing_id().alias("item"), column(item_col).alias("item_id"), column(item_text_col).alias("item_text")))
    windows = cut_lineage(_item_windows(items.select("item", F.col("item_text").alias("text")), rules))
    rows = _hit_rows(docs, windows, rules, id_col, text_col)
    entries = rows.select("r", F.explode("hits").alias("hash"))
    counted = join_hot(entries, _joined_windows(windows, rules), ["hash"], "inner", "r", entries.count()).groupBy("r", "item", "runs").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    pairs = cut_lineage(counted.where("n >= need").select("r", "item").distinct())
    both = pairs.join(rows.drop("hits"), "r")
    both = join_hot(both, items, ["item"], "inner", "r", pairs.count(), pairs)

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, Any]]:
        forms: dict[str, list[Form]] = {}
        for b in batches:
            at, out = [], []
            for i, (text, item_text) in enumerate(zip(b["text"], b["item_text"].to_pylist(), strict=True)):
                if item_text not in forms:
                    if len(forms) > 100:
                        forms.clear()
                    forms[item_text] = forms_of(item_text, rules)
                plain = template(text.as_py())
                found = matched(forms[item_text], plain, merged(*plain), rules)
                if found and found[2] >= rules.consistent:
                    at.append(i)
                    out.append(found)
            if at:
                take = pa.array(at, pa.int64())
                yield {c: b[c].take(take) for c in ("k", "h", "id", "item_id")} | dict(zip(("windows_found", "item_windows", "agreement", "replaced"), map(list, zip(*out, strict=True)), strict=True))

    output = StructType(
        [*struct_type("k long, h long"), StructField("id", type_of(docs, id_col)), StructField("item_id", type_of(benchmark, item_col)), *struct_type("windows_found int, item_windows int, agreement double, replaced boolean")]
    )
    return map_batches(both, {c: F.col(c) for c in ("k", "h", "id", "item_id", "text", "item_text")}, output, run)


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item it contains: id, item, windows found, the item's windows, agreement, replaced."""
    found = _matches(docs, benchmark, rules, id_col, text_col, item_col, item_text_col).drop("k", "h")
    return found.toDF(id_col, item_col, *found.columns[2:])


def clean(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of the benchmark. Few keys to drop are broadcast, others joined."""
    k, h = (fresh(docs.columns, c) for c in ("__k", "__h"))
    found = cut_lineage(_matches(docs, benchmark, rules, id_col, text_col, item_col, item_text_col).select(F.col("k").alias(k), F.col("h").alias(h)).distinct())
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(_keys(id_col, text_col), (k, h), strict=True)))
    small = found.count() <= rules.most_keys
    return keyed.join(F.broadcast(found) if small else found, [k, h], "left_anti").select(*(column(c) for c in docs.columns))
