"""Secret scans with DataFrame functions only.

Three rules find secrets by form. Two character Markov models, one of random
strings and one of ordinary identifiers and words, add what has no known form:
a run of token characters whose mean log-likelihood ratio is high is reported too.

Defined results: a null or empty text has no spans; equal rows get equal
results; ties cannot occur, since spans of one kind never overlap; an empty
table gives an empty result; columns other than the id and the text are ignored.
The work for a text of any length follows its length and the number of its spans
(but for sums over some thousandths of the spans, which are quadratic).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm.common import column, fresh, let, sampled

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A greedy run of the right length is the same span as a greedy run of any length that is then found long enough.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "markov")
_SPAN = ("start", "rank", "kind", "end")
_CHUNK = 32
_WORDS = (
    "get set is has make build find load save read write open close start stop init run add remove update delete create parse "
    "format value name path file user index count size list map key type node item data config request response handler service "
    "manager factory client server session table column row field test case error message status state event listener default"
).split()


def _running(values: Column, op: Callable[[Column, Column], Column], zero: int, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function that reduces all values before an index with ``op``: from chunks, chunks of chunks, and single values."""
    reduce = lambda a: F.aggregate(a, F.lit(zero), op)
    part = lambda a, start, n: reduce(F.slice(a, start + 1, n))
    whole = lambda i, size: F.floor(i / size).cast("int")

    def with_chunks(c: Column) -> Column:
        upper = F.transform(F.sequence(F.lit(0), whole(F.size(c), _CHUNK)), lambda k: part(c, F.lit(0), k * _CHUNK))

        def with_upper(u: Column) -> Column:
            def before(i: Column) -> Column:
                k, m = whole(i, _CHUNK), whole(i, _CHUNK * _CHUNK)
                return op(op(F.get(u, m), part(c, m * _CHUNK, k - m * _CHUNK)), part(values, k * _CHUNK, i - k * _CHUNK))

            return body(before)

        return let(upper, with_upper)

    return let(F.transform(F.sequence(F.lit(0), whole(F.size(values), _CHUNK)), lambda k: part(values, k * _CHUNK, F.lit(_CHUNK))), with_chunks)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _positions(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans of all leftmost, non-overlapping matches, in code points, as array<struct<start,rank,kind,end,hit>>.

    The text between matches and the matches themselves give the offsets.
    """
    rank = KINDS.index(kind)
    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")).alias("values"),
    )

    def spans(v: Column) -> Column:
        lens = F.zip_with(v["gaps"], v["hits"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))

        def told(before: Callable[[Column], Column]) -> Column:
            def one(hit: Column, i: Column) -> Column:
                start = before(i) + F.length(F.get(v["gaps"], i))
                ok = F.length(F.get(v["values"], i)) >= least if group else F.lit(True)
                return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(hit)).alias("end"), hit.alias("hit"), ok.alias("ok"))

            kept = F.filter(F.transform(v["hits"], one), lambda s: s["ok"])
            return F.transform(kept, lambda s: F.struct(*(s[c].alias(c) for c in _SPAN), s["hit"].alias("hit")))

        return let(lens, lambda n: _running(n, _add, 0, told))

    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,hit:string>>")
    return F.when(text.rlike(pattern), let(found, spans)).otherwise(none)


def _without_hits(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in _SPAN)))


def _apart(more: Column, base: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``; both are sorted, and spans of ``more`` come after those of ``base`` with the same start."""
    rank = KINDS.index("markov")
    far = 2_147_483_647
    ranked = F.array_sort(F.concat(F.transform(base, lambda s: F.struct(*(s[c].alias(c) for c in _SPAN), F.lit("").alias("hit"))), more))

    def in_order(a: Column) -> Column:
        ends = F.transform(a, lambda s: F.when(s["rank"] == rank, 0).otherwise(s["end"]))
        starts = F.reverse(F.transform(a, lambda s: F.when(s["rank"] == rank, far).otherwise(s["start"])))

        def with_ends(last_end: Callable[[Column], Column]) -> Column:
            def with_starts(next_start: Callable[[Column], Column]) -> Column:
                return F.filter(a, lambda s, i: (s["rank"] == rank) & (last_end(i) <= s["start"]) & (next_start(F.size(a) - 1 - i) >= s["end"]))

            return let(starts, lambda v: _running(v, _smaller, far, with_starts))

        return let(ends, lambda v: _running(v, _larger, 0, with_ends))

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(let(ranked, in_order))


@dataclass(frozen=True)
class MarkovRatio:
    """log P(random) - log P(ordinary) for each pair of neighbouring ASCII characters, as one flat table."""

    table: tuple[float, ...]
    threshold: float = 1.0

    def mean_ratio(self, token: Column) -> Column:
        """Mean log-likelihood ratio per transition of an ASCII token."""
        weights = F.from_json(F.lit(json.dumps([round(x, 4) for x in self.table])), "array<double>")

        def summed(codes: Column) -> Column:
            steps = F.sequence(F.lit(1), F.size(codes) - 1)
            return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.get(weights, F.get(codes, i - 1) * 128 + F.get(codes, i))) / (F.size(codes) - 1)

        return let(F.transform(F.split(token, ""), F.ascii), summed)


def labelled_samples(spark: SparkSession, documents: DataFrame | None = None, strings: int = 2_000, documents_sampled: int = 1_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, random): random strings made by rule; ordinary ones are identifiers made by rule and words of sampled documents.

    At most about ``documents_sampled`` documents are read for words; that is the stated bound of the training sample.
    """
    seed = spark.range(strings).select(F.sha2(F.concat(F.lit("r"), F.col("id")), 512).alias("h"), "id")
    b64 = F.regexp_replace(F.base64(F.unhex("h")), r"\s", "")
    random = seed.select(F.explode(F.array(F.substring(b64, 1, 40), F.substring("h", 1, 40), F.upper(F.regexp_replace(F.substring(b64, 1, 48), "[^A-Za-z0-9]", "")))).alias("token"))
    word = lambda k: F.element_at(F.lit(_WORDS), (F.pmod(F.hash("id", F.lit(k)), F.lit(len(_WORDS))) + 1).cast("int"))
    a, b, c = word(1), word(2), word(3)
    made = spark.range(strings).select(F.explode(F.array(F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.upper(F.concat_ws("_", a, b)), F.concat_ws("/", a, b, c), F.concat_ws("-", a, b, c))).alias("token"))
    ordinary = made
    if documents is not None:
        # what the rules find is no ordinary word
        text = F.regexp_replace(F.coalesce(column(text_col), F.lit("")), f"{ASSIGN}|{ACCESS}|{HEX}", " ")
        words = sampled(documents, id_col, documents_sampled).select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0)))).alias("token"))
        ordinary = made.unionByName(words).unionByName(words.select(F.upper("token").alias("token")))
    return random.withColumn("random", F.lit(1)).unionByName(ordinary.withColumn("random", F.lit(0)))


def train(samples: DataFrame, threshold: float = 1.0, smoothing: float = 0.2) -> MarkovRatio:
    """Count transitions per label; the result is bounded by the alphabet (128 x 128), whatever the sample's size."""
    pairs = samples.where(F.length("token") > 1).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.struct(F.ascii(F.substring(F.col("token"), i, F.lit(1))).alias("a"), F.ascii(F.substring(F.col("token"), i + 1, F.lit(1))).alias("b")))).alias("p"))
    rows = pairs.where((F.col("p.a") < 128) & (F.col("p.b") < 128)).groupBy("random", F.col("p.a").alias("a"), F.col("p.b").alias("b")).count().collect()
    counts = [[[0.0] * 128 for _ in range(128)] for _ in range(2)]
    for r in rows:
        counts[r["random"]][r["a"]][r["b"]] = float(r["count"])
    symbols = 66
    logs = []
    for m in counts:
        logs.append([[math.log((x + smoothing) / (sum(row) + smoothing * symbols)) for x in row] for row in m])
    return MarkovRatio(tuple(logs[1][a][b] - logs[0][a][b] for a in range(128) for b in range(128)), threshold)


def spans_of(text: Column, model: MarkovRatio) -> Column:
    """struct<base_spans, spans> of a text column without nulls: what the rules find, and that with what the model adds.

    Both are array<struct<start,rank,kind,end>>, sorted by start, then kind.
    """
    ruled = _without_hits(F.array_sort(F.concat(_positions(text, ASSIGN, "assign", 2, 6), _positions(text, ACCESS, "access"), _positions(text, HEX, "hex"))))

    def with_base(b: Column) -> Column:
        def with_more(m: Column) -> Column:
            added = F.filter(_apart(m, b), lambda c: model.mean_ratio(c["hit"]) > model.threshold)
            spans = F.when(F.size(m) == 0, b).otherwise(F.array_sort(F.concat(b, _without_hits(added))))
            return F.struct(b.alias("base_spans"), spans.alias("spans"))

        return let(_positions(text, CANDIDATE, "markov"), with_more)

    return let(ruled, with_base)


def find_secrets(df: DataFrame, model: MarkovRatio, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, the columns ``keep``, the text (null: empty), ``base_spans`` and ``spans``."""
    ids = [column(c).alias(f"k{i}") for i, c in enumerate((id_col, *keep))]
    texts = df.select(*ids, F.coalesce(column(text_col), F.lit("")).alias("t"))
    found = texts.withColumn("found", spans_of(F.col("t"), model))
    return found.select(*(f"k{i}" for i in range(len(ids))), "t", "found.base_spans", "found.spans").toDF(id_col, *keep, "text", "base_spans", "spans")


def mask(df: DataFrame, model: MarkovRatio, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows and columns of ``df``, secrets in the text masked, the number of its characters corrected. Texts without any stay as they are, null too."""
    found = fresh(df.columns, "__found")
    masked = df.withColumn(found, spans_of(F.coalesce(column(text_col), F.lit("")), model)["spans"])
    masked = masked.withColumn(text_col, redacted(column(text_col), column(found)))
    hits = F.size(column(found)) > 0
    chars = lambda c: F.when(hits, F.length(column(text_col))).otherwise(column(c)).cast(df.schema[c].dataType).alias(c)
    return masked.select(*(chars(c) if c == chars_col else column(c) for c in df.columns))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans are masked once. In four bytes a code point every slice is found at once."""

    def with_bytes(b: Column) -> Column:
        def told(last_end: Callable[[Column], Column]) -> Column:
            def piece(s: Column, i: Column) -> Column:
                at = last_end(i)
                between = F.decode(F.substring(b, at * 4 + 1, (s["start"] - at) * 4), "UTF-32")
                return F.when(s["start"] < at, "").otherwise(F.concat(between, F.lit(mask)))

            end = last_end(F.size(spans))
            return F.concat(F.array_join(F.transform(spans, piece), ""), F.decode(F.substring(b, end * 4 + 1, F.octet_length(b)), "UTF-32"))

        return let(F.transform(spans, lambda s: s["end"]), lambda v: _running(v, _larger, 0, told))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.encode(text, "UTF-32"), with_bytes))


def secret_digest(df: DataFrame, model: MarkovRatio) -> DataFrame:
    """The digest columns of the registered query."""
    found = find_secrets(df, model)
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
