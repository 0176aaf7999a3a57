"""The operators against brute force, exact round trips and held-out accuracy, and on hard inputs."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gossamer.llm import bpe, chatformat, decontam, imatch, langid, licenses, neardup, secrets, substrings, toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long, t int, k string, id int, tag string, b int, copy int, spans string, runs int, first boolean, `odd name` int"
WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu ra se ti vo wu".split() for b in "ban cel dim for gus".split()]


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def table(spark, rows):
    """(doc_id, text, lang) rows with all the other columns, among them ones that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "x", 2, "y", 3, 4, "z", 5, True, 6) for i, t, lang in rows], DDL)


def hard_rows():
    long = prose(1, 30_000)
    near = prose(2, 300).split()
    edited = [*near[:150], "changed", *near[151:]]
    return [
        (1, None, None), (2, "", "en"), (3, long, "en"), (4, " ".join(near), "en"), (5, " ".join(edited), "en"), (6, " ".join(near), "en"), (6, " ".join(near), "en"), (None, "no id " + prose(3, 60), "en"),
        (None, None, None), (7, "   \x1c\x85", "en"), (8, "\U0001f600 中文 é <|endoftext|> x", "fr"), (9, "x" * 5_000, "en"), (10, "token=abc secret: 'hunter22'", None), (11, "a\x00b" + prose(4, 50), "fr"), (12, "1 2 3 !!", "en"),
    ]


@pytest.fixture(scope="module")
def hard(spark):
    return table(spark, hard_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- secrets ----

RULES = ((0, "assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)), (1, "access", re.compile("AKIA[A-Z0-9]+")), (2, "hex", re.compile("[0-9a-f]+")))


def plain_spans(text):
    out = []
    for rank, kind, rule in RULES:
        for m in rule.finditer(text):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_secrets(spark, hard, empty):
    model = secrets.train(secrets.labelled_samples(spark, hard, 300, 50))
    rnd = random.Random(1)
    pieces = ["token:", "token=abc", "api_key = 'zzzzzzz", "PASSWORD:\"q1w2e3", "AKIA" + "A1" * 8, "AKIA" + "B" * 15, "AKIAAKIA" + "Z" * 12, "0123456789abcdef" * 2, "deadbeef", "\U0001f600", "é", " ", "\n", "secret:secret:longenough", "=", "x"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25))) for _ in range(150)] + ["0123456789abcdef01234567 " * 700]
    df = table(spark, [(i, t, "en") for i, t in enumerate(texts)]).unionByName(hard)
    rows = secrets.secret_digest(df, model).collect()
    assert len(rows) == len(texts) + hard.count()
    for r in rows[: len(texts)]:
        assert r["base_sha256"] == hashlib.sha256(plain_spans(texts[r["doc_id"]]).encode()).hexdigest(), texts[r["doc_id"]]
    assert secrets.secret_digest(empty, model).count() == 0
    one = lambda t: secrets.find_secrets(table(spark, [(1, t, None)]), model).select("spans", secrets.redacted(F.col("text"), F.col("spans")).alias("r")).first()
    found = one("see gA8fK2lQz9XwP4vBn7RtYcQ2 and internationalization_support_helper ok")
    assert [s["kind"] for s in found["spans"]] == ["markov"] and found["r"] == "see [SECRET] and internationalization_support_helper ok"
    assert one(None)["r"] == "" and one("é token=abcdefgh!")["r"] == "é [SECRET]!"


# ---- BPE ----


def test_bpe(spark, hard, empty):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = bpe.round_trip_digest(hard).collect()
    assert len(rows) == hard.count()
    want = collections.Counter()
    for r in hard.collect():
        e = reference.encode(r["text"] or "", add_special_tokens=False)
        want[(r["doc_id"], len(e.ids), sha(",".join(map(str, e.ids))), sha(reference.decode(e.ids, skip_special_tokens=False)))] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    back = bpe.decode(bpe.encode(hard.where("doc_id = 8")))
    assert back.first()["text"] == hard.where("doc_id = 8").first()["text"]
    assert bpe.round_trip_digest(empty).count() == 0 and bpe.tokenized(hard).where("not exact").count() == 0


# ---- toxicity ----


def test_toxicity(spark, hard, empty):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [rnd.choice(WORDS) for _ in range(40)]
        if bad:
            w[rnd.randrange(40)] = rnd.choice(("moron", "scum"))
        rows.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(bad)))
    docs = table(spark, rows)
    got = toxicity.toxicity_digest(docs, labels_of(spark, [*labels, (None, 1, 1), (5, None, None), labels[0]])).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 600 and 60 < len(held) < 180
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.toxicity_digest(hard, labels_of(spark, [])).where("score <> 0.5").count() == 0
    assert toxicity.toxicity_digest(empty, labels_of(spark, labels)).count() == 0


# ---- fingerprints ----


def plain_fingerprint(text, known):
    """Signatures written out: sorted hashes of the lexicon's words, then of those that each subset's own hash selects."""
    m = (1 << 64) - 1
    own = sorted(xxhash.xxh3_64_intdigest(w) >> 16 for w in set(text.lower().split()) & known)
    if not own:
        return "0" + hashlib.sha256(text.encode()).hexdigest()[:31]
    pack = lambda terms: b"".join(t.to_bytes(8, "little") for t in terms)
    out = [xxhash.xxh3_64_hexdigest(pack(own))]
    for r in range(30):
        chosen = []
        for t in own:
            h = (t ^ ((r + 1) * 0x9E3779B97F4A7C15 & m)) * 0xD6E8FEB86659FD93 & m
            h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 & m
            if (h ^ (h >> 32)) % (4, 16, 64, 256, 1024)[r // 6] == 0:
                chosen.append(t)
        out.append(f"{xxhash.xxh3_64_intdigest(pack(chosen)) & 0xFFFFFFFF:08x}" if chosen else "")
    return ".".join(out)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    a, b = a.split(".")[1:], b.split(".")[1:]
    if len(a) != len(b) or not a:
        return 0.0
    shares = []
    for k in range(0, 30, 6):
        told = [(x, y) for x, y in zip(a[k : k + 6], b[k : k + 6], strict=True) if x or y]
        shares.append(sum(x == y for x, y in told) / (len(told) + 0.5))
    return max(0.0, *shares)


def test_fingerprints(spark, hard, empty):
    rows = [(i * 7 % 401, prose(i % 90, 30 + i % 50), "en") for i in range(120)]
    df = table(spark, rows).repartition(5)
    got = {r["doc_id"]: r for r in imatch.fingerprint_digest(df).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    by_text = collections.defaultdict(set)
    for (i, text, _), (_, following, _) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        k = len(text) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - k] + following[:k]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(text) and 0 <= got[i]["near_next"] <= 1
        by_text[text].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    counts = collections.Counter(w for _, t, _ in rows for w in set(t.split()))
    freq = imatch.document_frequencies(df, 5, 20, buckets=7).collect()
    assert {r["term"]: r["df"] for r in freq} == {int(imatch.terms_of(w)[0]): n for w, n in counts.items() if 5 <= n <= 20}
    known = {w for w, n in counts.items() if max(1, math.ceil(0.002 * len(rows))) <= n <= int(0.2 * len(rows))}
    for (i, text, _), (_, following, _) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        prints = [plain_fingerprint(t, known) for t in (text, text[: len(text) - len(text) // 3] + following[: len(text) // 3], following)]
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (prints[0], prints[1])
        assert (got[i]["near_edited"], got[i]["near_next"]) == (plain_likeness(prints[0], prints[1]), plain_likeness(prints[0], prints[2]))
    joined = {r["doc_id"]: r for r in imatch.fingerprint_digest(df, imatch.Band(most_terms=3)).collect()}
    assert joined == got
    assert imatch.fingerprint_digest(hard).count() == hard.count() and imatch.fingerprint_digest(empty).count() == 0
    alone = imatch.fingerprint_digest(table(spark, [(1, "abcdef", "en")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone["near_next"] == 1.0


# ---- substrings ----


def plain_kept(texts, w):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(x[p : p + w]) for x in words for p in range(len(x) - w + 1))
    out = []
    for x in words:
        covered = {q for p in range(len(x) - w + 1) if seen[tuple(x[p : p + w])] > 1 for q in range(p, p + w)}
        stay = [a for i, a in enumerate(x) if i not in covered]
        out.append((len(x), len(covered), hashlib.sha256(" ".join(stay).encode()).hexdigest()))
    return out


def test_substrings(spark, hard, empty):
    for period in (7, 13, 21):
        cover = substrings.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    rnd = random.Random(4)
    passage = prose(50, 80).split()
    texts = []
    for i in range(60):
        x = prose(100 + i, rnd.randint(5, 120)).split()
        if i % 3 == 0:
            a = rnd.randint(0, 40)
            cut = passage[a : a + rnd.randint(30, 40)]
            at = rnd.randint(0, len(x))
            x[at:at] = cut
        if i % 10 == 0:
            x = x + ["mid"] + x
        texts.append((" " if i % 2 else "\n\t").join(x))
    texts += [texts[3], texts[3], "a b " * 20, "z " * 36, None, ""]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup_digest(table(spark, rows).repartition(4)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_kept(texts, 35)
    h = hard.collect()
    want = collections.Counter((r["doc_id"], *x) for r, x in zip(h, plain_kept([r["text"] for r in h], 35), strict=True))
    assert collections.Counter(tuple(r) for r in substrings.dedup_digest(hard).collect()) == want
    assert substrings.dedup_digest(empty).count() == 0


# ---- licenses ----


def test_licenses(spark, hard, empty):
    import duckdb

    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0 header"]
    half = mit.index("The above")
    comment = "/*\n" + "\n".join(f" * {line}" for line in re.findall(r".{1,70}(?:\s|$)", apache)) + "\n */\npublic class Main {\n" + prose(60, 300) + "\n}"
    rows = [
        (1, "intro\nReleased under the MIT License.\nmore", "en"), (2, mit, "en"), (3, "RELEASED under  the; MIT licence", "en"), (4, "Licensed under CC BY-NC 4.0.\n\nAll rights reserved.", "en"),
        (5, licenses.TEMPLATES["ISC"].replace("fee", "fees"), "en"), (6, None, "en"), (7, "mit license", "en"), (8, "This work is licensed under the GNU General Public License, version 2.", "en"), (9, "", "en"),
        (10, comment, "en"), (11, f"{prose(61, 500)}\n\n{mit[:half]}\n\n{mit[half:]}\n\n{prose(62, 500)}", "en"), (12, f"{prose(63, 20)}, which is Released\nunder the MIT License. {prose(64, 20)}", "en"),
        (13, prose(65, 30) + " " + licenses.TEMPLATES["BSD-3-Clause"].replace("THE COPYRIGHT HOLDERS", "THE REGENTS") + " " + prose(66, 30), "en"),
        (14, prose(67, 10) + " GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n" + prose(68, 100), "en"), (15, " ".join(mit.split()[: len(mit.split()) // 2]), "en"), (16, "This wor\u212a is LICENSED under the GNU General Public License, version 2.", "en"),
        (17, " ".join(w for i, w in enumerate(mit.split()) if i % 25) + " end", "en"), (17, licenses.TEMPLATES["LGPL-2.1 header"], "en"),
    ]
    df = table(spark, rows).unionByName(hard)
    got = collections.Counter(tuple(r) for r in licenses.scan(df).select("doc_id", "license", "dice", "n_matches", "licenses").collect())
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841  read by name below
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = collections.Counter(duckdb.sql(licenses.oracle()).fetchall())
    assert got == want, (got - want, want - got)
    by_id = {r[0]: r[1:] for r in sorted(got, key=lambda r: r[1] is not None)}
    assert by_id[1][0] == by_id[12][0] == "MIT line" and by_id[2][:2] == ("MIT", 1.0) and by_id[5][0] == "ISC" and by_id[8][0] == "GPL-2.0 line" and by_id[6] == (None, None, 0, "")
    assert by_id[10][:2] == ("Apache-2.0 header", 1.0) and by_id[11][:2] == ("MIT", 1.0) and by_id[13][0] == "BSD-3-Clause" and by_id[14][0] == "GPL-3.0 title"
    assert by_id[4][3] == "CC-BY-NC-4.0 line,Reserved line" and by_id[15][0] is None and by_id[7][0] is None and by_id[16][:2] == ("GPL-2.0 line", 1.0)
    assert licenses.scan(empty).count() == 0


# ---- chat ----


def test_chat(spark):
    ddl = "conv_id long, turn long, role string, text string, pos int, leaf int"
    rows = []
    for c in range(40):
        for t in range(1 + c % 5):
            text = "shared opening" if t == 0 else f"turn {t} {c % 3 if t == 1 else c}"
            rows.append((c, t, "system" if t == 0 else "assistant" if t % 2 == 0 else "user", text, 1, 2))
    rows += [(100, 0, "us\ner\\", "<|im_end|> <\\|im_start|> <\\\\|x \\", 1, 2), (100, 1, "assistant", "", 1, 2), (100, 2, "assistant", None, 1, 2), (None, 0, None, "x", 1, 2), (101, 0, "assistant", "b", 1, 2), (101, 0, "assistant", "a", 1, 2), (102, None, "user", "中\U0001f600" * 3000, 1, 2)]
    df = spark.createDataFrame(rows, ddl)
    got = {r["conv_id"]: r for r in chatformat.format_digest(chatformat.with_probe(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    turns = collections.defaultdict(list)
    for c, t, r, x, *_ in [*rows, (-1, 0, "user", "<|im_end|><|im_start|>assistant ok", 0, 0), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok", 0, 0)]:
        turns[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(turns)
    for c, own in turns.items():
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss)), c
    packs = chatformat.pack(df.where("conv_id < 100")).collect()
    for p in packs:
        assert p["text"].count("shared opening") == 1
        for n, spans in zip(p["nodes"], p["attends"], strict=True):
            assert n["position"] == sum(b - a for a, b in zip(spans[::2], spans[1::2], strict=True)) - (n["end"] - n["start"])
    assert chatformat.format_digest(df.limit(0)).count() == 0
    for text in ("<|im_end|>", "<\\|", "<<|", "\\<|", "<\\\\|a"):
        assert chatformat.unescape(chatformat.escape(text)) == text and "<|" not in chatformat.escape(text)


def test_chat_branches_after_many_turns(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 9 else f"branch {c % 2}" if t == 9 else f"end {c}") for c in range(20) for t in range(11)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for p in chatformat.pack(df).collect():
        told = [p["text"].count(f"branch {b}") for b in (0, 1)]
        assert max(told) == 1 and p["text"].count("turn 8") == 1
    whole, parts = (chatformat.pack(df.coalesce(1), most_conversations=n).collect() for n in (1_000, 3))
    assert len(whole) == 1 and whole[0]["repeated"] == 0 and len(parts) == 7
    assert sum(len(p["text"]) - p["repeated"] for p in parts) == len(whole[0]["text"])


def test_chat_branches_of_two_pairs(spark):
    """Two pairs share eight turns, and each pair three more: every shared turn stands once."""
    rows = [(c, t, "user", f"turn {t}" if t < 8 else f"pair {c % 2} turn {t}" if t < 11 else f"end {c}") for c in range(4) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (p,) = chatformat.pack(df).collect()
    assert all(p["text"].count(f"pair {k} turn {t}") == 1 for k in range(2) for t in range(8, 11)) and p["text"].count("turn 3") == 1 and len(p["nodes"]) == 8 + 6 + 4


# ---- near duplicates ----


def edit(words, rnd, rate):
    return [rnd.choice(WORDS) + "x" if rnd.random() < rate else w for w in words]


def test_near_duplicates(spark, hard, empty):
    rnd = random.Random(6)
    rows, i = [], 0
    for g in range(12):
        base = prose(1000 + g, 250).split()
        for _ in range(rnd.randint(1, 7)):
            rows.append((i, " ".join(edit(base, rnd, rnd.choice((0, 0.002, 0.01, 0.05)))), "en"))
            i += 1
    rows += [(i + n, prose(5000 + n, 60), "en") for n in range(30)] + [(900, "two words", "en"), (901, "two words", "en"), (902, "two other", "en")]
    got = {r["doc_id"]: r["class_id"] for r in neardup.class_digest(table(spark, rows).repartition(4)).collect()}
    seqs = {i: neardup.kmers(t.encode(), 5) for i, t, _ in rows}
    parent = {i: i for i in seqs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def similarity(a, b):  # longest common subsequence by the textbook table
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1] / (len(a) + len(b) - row[-1])

    for a in seqs:
        for b in seqs:
            if a < b and len(set(seqs[a].tolist()) & set(seqs[b].tolist())) > 0.5 * min(len(seqs[a]), len(seqs[b])):
                s = similarity(seqs[a].tolist(), seqs[b].tolist())
                assert (s >= 0.8) == (neardup.aligned_similarity(seqs[a], seqs[b], 0.8) >= 0.8)
                if s >= 0.8:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: root(i) for i in seqs}
    classes = {r["doc_id"]: r["class_id"] for r in neardup.class_digest(hard).collect() if r["doc_id"] is not None}
    assert classes[4] == classes[5] == classes[6] == 4 and classes[1] == classes[2] and classes[3] == 3
    kept = neardup.first_of_each(hard)
    assert kept.columns == hard.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 7, 8, 9, 10, 11, 12]
    assert neardup.class_digest(empty).count() == 0


def test_large_bucket(spark):
    rnd = random.Random(8)
    base = prose(77, 120).split()
    rows = [(i, " ".join(edit(base, rnd, 0.004)), "en") for i in range(300)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.class_digest(table(spark, rows).repartition(6), neardup.Rules(block=32)).collect()}
    seqs = [neardup.kmers(t.encode(), 5) for _, t, _ in rows]
    label = list(range(300))
    for a in range(300):
        for b in range(a):
            if label[a] != label[b] and neardup.aligned_similarity(seqs[a], seqs[b], 0.8) >= 0.8:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert [got[i] for i in range(300)] == label


def test_similarity_at_the_threshold():
    long = np.arange(1, 100_001, dtype=np.uint64)
    for k in [*range(1, 2_000), *range(2_000, 20_000, 37), 19_999, 20_000]:
        for a, b in ((long[: 4 * k], long[: 5 * k]), (long[: 5 * k], long[k : 5 * k])):
            assert neardup.aligned_similarity(a, b, 0.8) == 0.8, k
    assert neardup.aligned_similarity(long[:27], long[:35], 0.8) < 0.8


def test_estimate_loses_fewer_links_than_the_sketches():
    rules = neardup.Rules()
    p, lg = rules.similarity, math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    for union in (100, 250, 500, 1_250, 5_000, 20_000, 50_000):
        common = math.ceil(p * union)
        either = round(neardup.BINS * (1 - (1 - 1 / neardup.BINS) ** union))
        least = p * either - rules.sigmas * math.sqrt(p * (1 - p) * either * (union - either) / (union - 1)) - 1
        lost = (x for x in range(max(0, either - (union - common)), math.ceil(least)))
        assert sum(math.exp(choose(common, x) + choose(union - common, either - x) - choose(union, either)) for x in lost) < 1e-5, union


def test_null_ids_among_near_copies(spark):
    rnd = random.Random(9)
    rows = []
    for g, ids in enumerate(((None, 7, 5, None), (None, None, None), (None,))):
        base = prose(3000 + g, 200).split()
        rows += [(i, " ".join([*base[: 20 * n], rnd.choice(WORDS) + "x", *base[20 * n :]]), "en") for n, i in enumerate(ids, 1)]
    group = {text: g for g, ids in ((0, rows[:4]), (1, rows[4:7]), (2, rows[7:])) for _, text, _ in ids}
    by_hash = {r["t"]: group[r["text"]] for r in table(spark, rows).select("text", F.xxhash64("text").alias("t")).collect()}
    got = collections.defaultdict(list)
    for r in neardup.classes(table(spark, rows).repartition(3)).collect():
        got[by_hash[r["t"]]].append(r)
    assert {g: len({r["class_id"] for r in x}) for g, x in got.items()} == {0: 1, 1: 1, 2: 1}
    assert got[0][0]["class_id"] == 5 and len({x[0]["class_id"] for x in got.values()}) == 3
    kept = [group[r["text"]] for r in neardup.first_of_each(table(spark, rows)).collect()]
    assert sorted(kept) == [0, 1, 2]


# ---- decontamination ----


def test_decontamination(spark, hard, empty):
    items = [(1, "A train leaves Paris with 120 passengers and travels 300 km in 4 hours before it stops near a small village"), (2, prose(9, 30)), (3, "tiny item"), (4, None), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, prose(10, 40) + " " + items[1][1] + " " + prose(11, 30), "en"),
        (2, "note. A train leaves Berlin with 95 passengers and travels 780 miles in 9 hours before it stops near a small village. " + prose(12, 20), "en"),
        (3, prose(13, 200), "en"), (4, " ".join(items[1][1].split()[:10]) + prose(14, 50), "en"), (5, None, "en"), (6, "a tiny item here", "en"), (7, items[1][1].upper(), "en"),
    ]
    docs = table(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r["replaced"] for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 2): False, (2, 1): True, (6, 3): False, (7, 2): False}
    small = decontam.Rules(bits=16, common=0, most_keys=0)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench, small).collect()} == set(got)
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench, small).collect()) == [3, 4, 5] and decontam.clean(docs, bench).columns == docs.columns
    assert decontam.contaminated(hard, bench).count() == 0 and decontam.contaminated(empty, bench).count() == 0 and decontam.clean(hard, bench.limit(0)).count() == hard.count()
    mixed = items[0][1].replace("300", "7").replace("120", "8")
    index = decontam.Index([(1, items[0][1] + " and 300 more with 300 less")], decontam.Rules())
    (hit,) = index.matches(mixed + " and 9 more with 11 less", decontam.Rules())
    assert hit[3] < 1.0


def test_decontamination_by_occurrence():
    repeated = "In June Alice has 5 apples and Bob has 7 apples and Carol has 9 apples in total"
    train = "A train leaves Paris with 120 passengers and travels 300 km in 4 hours before it stops near a small village"
    variant = train.replace("120", "95").replace("300", "780").replace("Paris", "Berlin")
    other = train.replace("120", "11").replace("300", "222").replace("Paris", "Rome")
    index, rules = decontam.Index([(1, repeated), (2, train)], decontam.Rules()), decontam.Rules()
    found = lambda text: {m[0]: (m[1] / m[2], *m[3:]) for m in index.matches(text, rules) if m[3] >= rules.consistent}
    assert found(f"{prose(20, 40)}. {repeated}. {prose(21, 40)}") == {1: (1.0, 1.0, False)}
    assert found(f"{train}. {prose(22, 60)}. {variant}.") == {2: (1.0, 1.0, False)}
    assert found(f"{variant}. {prose(22, 60)}. {other}.") == {2: (1.0, 1.0, True)}
    words = train.split()
    edited = " ".join([*words[:11], "quite", "surely", *words[11:]])
    assert set(found(f"{edited}. {prose(23, 60)}. {' '.join(variant.split()[:14])}. {other}")) == {2}
    assert found(train.replace("before it", "but never")) == found(f"{train.replace('before it', 'but never')}. {prose(24, 30)}")
    assert not found(f"{prose(25, 200)}")


def test_decontamination_by_values_of_other_lengths():
    short = "yesterday in Paris they counted 12 old red boats on the river"
    long = "we know that Mary bought 3 kg of apples at the market in Paris and then sold 2 kg of pears to a man who lives near London with his old mother"
    rules = decontam.Rules()
    index = decontam.Index([(1, short), (2, long), (3, "the Quick Brown Fox")], rules)
    found = lambda text: {m[0]: m[4] for m in index.matches(text, rules) if m[3] >= rules.consistent}
    assert found(f"{prose(26, 30)}. {short.replace('Paris', 'New York')}. {prose(27, 30)}") == {1: True}
    assert found(long.replace("Mary", "Mary Ann").replace("Paris", "Rio Grande City").replace("London", "New York").replace("3 kg", "3")) == {2: True}
    assert found(short) == {1: False} and found(long) == {2: False} and found("see the Quick Brown Fox now") == {3: False}
    assert not found("see the Brown Fox now") and not found(prose(28, 200))
    assert set(found(f"{short.replace('12', '15')} {long}")) == {1, 2}


# ---- language ----


def test_language(spark, hard, empty):
    rnd = random.Random(3)
    syllables = {"aa": "ka lo mi ne tu".split(), "bb": "sch ung ein ber pf".split(), "cc": "ción ez as osa rr".split()}
    rows = []
    for i in range(300):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(30)), lang if i % 7 else None))
    got = langid.language_digest(table(spark, [*rows, (900, "12 !!", "aa"), (901, None, "aa")])).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert len(held) > 40 and all(r["lang_pred"] == ("aa", "bb", "cc")[r["doc_id"] % 3] for r in held)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] >= 900} == {900: ("und", 0.0), 901: ("und", 0.0)}
    assert langid.language_digest(hard).count() == hard.count() and langid.language_digest(empty).count() == 0
    assert langid.language_digest(table(spark, [(1, "word", None)])).first()["lang_pred"] == "und"
