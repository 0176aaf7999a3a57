"""Operators that learn or compare, against the same methods written out plainly."""

import collections
import math
import random
import re
import zlib

import numpy as np
import xxhash

from gossamer.llm import decontam, langid, toxicity
from tests.llm.test_llm import WORDS, labels_of, prose, table

MASK = (1 << 64) - 1
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


# ---- toxicity: FTRL-proximal, one coordinate at a time ----


def plain_features(text, bits):
    words = re.findall(r"\w+", (text or "").lower())
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    raw = [x * ODD[0] for x in h] + [xxhash.xxh3_64_intdigest(w[:5], 1) * ODD[1] for w in words]
    raw += [(a * ODD[1] & MASK) ^ ((b + ODD[0]) * ODD[2] & MASK) for a, b in zip(h, h[1:])]
    raw += [(a * ODD[3] & MASK) ^ ((b + ODD[1]) * ODD[2] & MASK) for a, b in zip(h, h[2:])]
    return sorted({0, *(((x & MASK) * ODD[2] & MASK) >> (64 - bits) for x in raw)})


def plain_ftrl(rows, labels, s):
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for x, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in x:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
                n[i] += g * g
    return {i: w for i in z if (w := weight(i))}


def test_toxicity_against_plain_ftrl(spark):
    rnd = random.Random(31)
    settings = toxicity.Ftrl(bits=12, l1=1.0, epochs=3)
    texts = [" ".join([*(rnd.choice(WORDS) for _ in range(12)), *(("scum",) if i % 3 == 0 else ())]) for i in range(150)] + ["", None, "Ünïcode wörds 12"]
    labels = [int(i % 3 == 0) for i in range(len(texts))]
    rows = [plain_features(t, settings.bits) for t in texts]
    assert [toxicity.features(t, settings.bits).tolist() for t in texts] == rows
    weights = plain_ftrl(rows, labels, settings)
    bins, values = toxicity.fit([np.array(x) for x in rows], labels, settings)
    assert bins.tolist() == sorted(weights) and np.allclose(values, [weights[i] for i in bins.tolist()], atol=1e-9)
    # the whole operator: learning follows the order of the ids' hashes
    docs = table(spark, [(i, t, "en") for i, t in enumerate(texts)])
    learned = toxicity.train(docs, labels_of(spark, [(i, 1, y) for i, y in enumerate(labels)]), settings)
    order = [r["doc_id"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS k").orderBy("k").collect()]
    weights = plain_ftrl([rows[i] for i in order], [labels[i] for i in order], settings)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, learned).collect()}
    for i, x in enumerate(rows):
        assert abs(got[i] - 1 / (1 + math.exp(-sum(weights.get(k, 0.0) for k in x)))) < 1e-5


# ---- language: bind, bundle, cosine ----


def plain_vector(text, letter, dims):
    """The sum over trigrams of the products of letters' vectors, each rotated by its distance from the end."""
    chars = re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} "))
    out = np.zeros(dims, np.int64)
    if chars.strip():
        for a, b, c in zip(chars, chars[1:], chars[2:]):
            out += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return out


def test_language_against_plain_vectors(spark):
    rnd = random.Random(32)
    space = langid.Space(dims=128)
    made = {}

    def letter(c):
        if c not in made:
            made[c] = np.random.default_rng([space.seed, ord(c)]).integers(0, 2, space.dims).astype(np.int64) * 2 - 1
        return made[c]

    syllables = {"aa": "ka lo mi ne tu".split(), "bb": "sch ung ein ber pf".split(), "cc": "ción ez as ñu rr".split()}
    rows = []
    for i in range(60):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(15)), lang))
    rows += [(100, "12, 34!", "aa"), (101, None, None), (102, "Ab-cd 9x", None), (103, "中文 \U0001f600 text", None)]
    docs = table(spark, rows)
    sums = {}
    for _, text, lang in rows:
        v = plain_vector(text, letter, space.dims)
        if lang and v.any():
            sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.train(docs, space)).collect()}
    for i, text, _ in rows:
        v = plain_vector(text, letter, space.dims)
        if not v.any():
            assert got[i] == ("und", 0.0)
            continue
        cosine = {lang: float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)) for lang, s in sorted(sums.items())}
        best = max(cosine, key=cosine.get)
        assert got[i][0] == best and abs(got[i][1] - min(1, max(0, cosine[best]))) < 1e-4
    # pieces change nothing
    encoder, small = langid.Encoder(space), langid.Encoder(space, most=10)
    small.PIECE = 7
    texts = [r[1] for r in rows]
    assert (encoder.documents(texts) == small.documents(texts)).all()
    assert (encoder.documents(texts[:5]) == [plain_vector(t, letter, space.dims) for t in texts[:5]]).all()


# ---- decontamination: all windows of all pairs ----

UNITS = {"km", "miles", "hours", "kg"}
NUMBERS = {"one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "twelve", "twenty"}


def plain_template(text):
    """(kind or word, value) of each token; names not at the start of a sentence."""
    out, before = [], "."
    for token in re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:\n]", text or ""):
        low, kind = token.lower(), "w"
        if token in ".!?:\n":
            before = "."
            continue
        if token[0].isdigit() or low in NUMBERS:
            kind = "N"
        elif low in UNITS and before == "N":
            kind = "U"
        elif len(token) > 1 and token[0].isupper() and not token[1:].isupper() and before != ".":
            kind = "T"
        out.append((kind, low))
        before = kind
    return out


def plain_runs(tokens):
    """Runs of names, of numbers, and a unit after them, as one."""
    out = []
    for kind, value in tokens:
        if out and (kind == "U" or kind in "TN" and out[-1][0] == kind):
            out[-1] = (out[-1][0], f"{out[-1][1]} {value}")
        else:
            out.append((kind, value))
    return out


def plain_found(item, text):
    for fold in (lambda x: x, plain_runs):
        a, b = fold(plain_template(item)), fold(plain_template(text))
        w = min(8, len(a))
        shown = lambda x, i: tuple(v if k == "w" else k for k, v in x[i : i + w])
        windows = [i for i in range(len(a) - w + 1) if sum(k == "w" for k, _ in a[i : i + w]) >= (4 if fold is plain_runs else min(4, w))]
        if not windows:
            if fold is plain_runs:
                continue
            windows = list(range(len(a) - w + 1))
        hits = [(p, q) for q in windows for p in range(len(b) - w + 1) if shown(a, q) == shown(b, p)]
        by_shift = collections.defaultdict(list)
        for p, q in hits:
            by_shift[p - q].append((p, q))
        for group in [hits, *by_shift.values()]:
            if not group or len({q for _, q in group}) < 0.5 * len(windows):
                continue
            slots = {(q + d, p + d) for p, q in group for d in range(w) if a[q + d][0] != "w"}
            share = 1.0
            for way in (0, 1) if slots else ():
                seen = collections.defaultdict(collections.Counter)
                for i, j in slots:
                    pair = a[i][1], b[j][1]
                    seen[pair[way]][pair[1 - way]] += 1
                share = min(share, sum(max(c.values()) for c in seen.values()) / len(slots))
            if share >= 0.8:
                return True
    return False


def test_decontamination_against_all_windows(spark):
    rnd = random.Random(33)
    names, units = ["Paris", "Rome", "New York", "Oslo", "Lima"], ["km", "miles", "hours", "kg"]
    value = lambda: rnd.choice([str(rnd.randint(2, 999)), rnd.choice(["two", "nine", "twelve", "twenty five"])])

    def question():
        parts = []
        for _ in range(rnd.randint(3, 5)):
            parts.append(prose(rnd.random(), rnd.randint(3, 6)) + rnd.choice([" {n}", " {v} {u}", " {v}"]))
        return " ".join(parts) + " " + prose(rnd.random(), 3)

    def filled(q):
        return re.sub(r"\{(.)\}", lambda m: {"n": lambda: rnd.choice(names), "v": value, "u": lambda: rnd.choice(units)}[m[1]](), q)

    questions = [question() for _ in range(12)]
    items = [(i, filled(q)) for i, q in enumerate(questions)] + [(50, None), (51, ""), (52, "short one")]
    docs = []
    for i in range(80):
        q = rnd.randrange(12)
        body = rnd.choice([items[q][1], filled(questions[q]), " ".join(items[q][1].split()[: rnd.randint(4, 20)]), prose(i + 700, 20)])
        docs.append((i, f"{prose(i, 15)}. {body}. {prose(i + 300, 15)}", "en"))
    docs += [(90, None, None), (91, "", None), (92, "a short one here", "en"), (92, "a short one here", "en")]
    want = collections.Counter((i, k) for i, text, _ in docs for k, item in items if plain_template(item) and plain_found(item, text))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for rules in (decontam.Rules(), decontam.Rules(common=0, bits=16)):
        got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontam.contaminated(table(spark, docs).repartition(3), benchmark, rules).collect())
        assert got == want
    assert 20 < len(want) and want[92, 52] == 2


def test_folds_are_those_of_crc32(spark):
    rows = table(spark, [(i, "x", "en") for i in range(200)]).select("doc_id", toxicity.fold(toxicity.F.col("doc_id")).alias("a"), langid.fold(langid.F.col("doc_id")).alias("b")).collect()
    assert all((r["a"], r["b"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 5, zlib.crc32(str(r["doc_id"]).encode()) % 4) for r in rows)
