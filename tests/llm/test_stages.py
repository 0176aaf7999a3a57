"""The pipeline as a whole, and each of its stages on hard inputs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gossamer.llm import bpe, neardup, secrets
from tests.llm.test_llm import WORDS, edit, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves, or that need quoting.
CLASHING = "score double, lang_pred string, spans string, base_spans int, text_ string, t int, k0 int, `a.b` int, `odd ``name` array<int>, h struct<x:int>, hits int"
CLASH = (0.5, "zz", "none", 1, "other", 2, 3, 4, [5], (6,), 7)


def test_pipeline(spark, tmp_path):
    item = prose(900, 30)
    rows = [(i, prose(i, 80), "en") for i in range(30)]
    rows += [(100, rows[3][1], "en"), (101, "?? 11", "en"), (102, prose(200, 40) + " token=abcdefgh12 " + prose(201, 30), "en"), (103, prose(202, 20) + " " + item + " " + prose(203, 20), "en"), (104, None, None)]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == {*range(30), 102}
    assert all(r["exact"] for r in out.values())
    masked = bpe.codec(open(bpe.default_vocabulary(), "rb").read()).decode(out[102]["ids"])
    assert "[SECRET]" in masked and "abcdefgh12" not in masked
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "bpe"] and corpus_pipeline.ORACLE_SQL is None


ITEM = prose(901, 40)
MANY = " ".join(f"token=abcdefgh{i:06d}" for i in range(20_000))


def hard_rows():
    rnd = random.Random(11)
    near = prose(30, 200).split()
    rows = [(i, prose(i, 60), "en") for i in range(6)]
    rows += [(10, None, None), (11, "", "en"), (None, "no id " + prose(40, 60), None), (None, None, None), (12, " ".join(near), "en"), (12, " ".join(near), "en"), (13, " ".join(edit(near, rnd, 0.01)), "en")]
    rows += [(14, f"{prose(41, 20)} {ITEM} {prose(42, 20)}", "en"), (15, MANY, "en"), (16, prose(43, 60_000), "en"), (17, "12 ?? \U0001f600", "en"), (18, f"{prose(44, 30)} password = 'hunter22' {prose(45, 30)}", None), (15, prose(46, 50), "en")]
    return rows


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """Nulls, empty and very long texts, ties, repeated rows, 20,000 secrets in one text, clashing columns; and a benchmark beside it."""
    folder = str(tmp_path_factory.mktemp("hard"))
    rows = [(i, t, lang, "s", len(t or ""), *CLASH) for i, t, lang in hard_rows()]
    spark.createDataFrame(rows, f"{COLUMNS}, {CLASHING}").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, "no id for this item but words enough")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


WANT = {
    "language_id": lambda r: r[1] is not None and any(c.isalpha() for c in r[1]),
    "decontamination": lambda r: ITEM not in (r[1] or ""),
    "secret_scan": lambda r: True,
}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_hard_rows(spark, hard, name):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, hard)
    rows = hard_rows()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    if name == "bpe":
        got = out.collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"] > 0) for r in got) == sorted((r[0] is None, r[0] or 0, bool(r[1])) for r in rows)
        assert all(r["exact"] for r in got)
        return
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    got = out.collect()
    assert all((r["score"], r["lang_pred"], r["spans"], r["a.b"], list(r["odd `name"]), r["h"]["x"]) == (0.5, "zz", "none", 4, [5], 6) for r in got)
    told = sorted(((r["doc_id"], r["text"]) for r in got), key=key)
    if name == "near_dedup":
        first = {}
        for i, t, _ in sorted(rows, key=key):
            first.setdefault(t or "", (i, t))
        del first[next(t for i, t, _ in rows if i == 13)]  # near 12
        assert [(i, t or "") for i, t in told] == sorted(((i, t or "") for i, t in first.values()), key=key)
        return
    want = sorted(((r[0], r[1]) for r in rows if WANT[name](r)), key=key)
    if name == "secret_scan":
        assert len(told) == len(want)
        by_id = {i: t for i, t in told if i in (10, 11, 16, 18)}
        assert by_id[10] is None and by_id[11] == "" and by_id[16] == prose(43, 60_000) and "hunter22" not in by_id[18] and "[SECRET]" in by_id[18]
        assert any(t == " ".join(["[SECRET]"] * 20_000) for _, t in told)
        assert all(r["n_chars"] == len(r["text"] or "") for r in got)
    else:
        assert told == want


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, hard, name):
    docs = spark.read.parquet(f"{hard}/documents.parquet").limit(0)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, hard)
    assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


def test_odd_names_of_keys(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "`odd id` long, `the text` string")
    back = bpe.decode(bpe.encode(df, id_col="odd id", text_col="the text"), id_col="odd id")
    assert {r["odd id"]: r["text"] for r in back.collect()} == {1: "one two", 2: ""}
    assert neardup.first_of_each(df, id_col="odd id", text_col="the text").count() == 2


def test_many_copies_of_one_key(spark):
    """A third of the rows share one text, another third one null id and text; groups meet limits that are far lower here."""
    rows = [(i, "the same words again and again", "en") for i in range(3_000)] + [(None, None, None)] * 3_000 + [(10_000 + i, prose(i, 30), "en") for i in range(600)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], COLUMNS).repartition(4)
    got = neardup.class_digest(docs).groupBy("class_id").count().collect()
    assert sorted(r["count"] for r in got)[-2:] == [3_000, 3_000] and len(got) == 602
    assert neardup.first_of_each(docs).count() == 602


def test_model_of_secrets_on_held_out_strings(spark):
    """The Markov models against strings they have not seen: keys of other alphabets and lengths, and identifiers of other words."""
    rnd = random.Random(21)
    alphabets = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
    keys = ["".join(rnd.choice(alphabets[i % 3]) for _ in range(rnd.randint(24, 64))) for i in range(300)]
    plain = ["_".join(rnd.choice(ENGLISH) for _ in range(rnd.randint(3, 6))) for _ in range(300)]
    plain += ["".join(rnd.choice(ENGLISH).title() for _ in range(rnd.randint(3, 6))) for _ in range(300)]
    plain = [p for p in plain if len(p) >= 20]
    documents = spark.createDataFrame([(i, " ".join(rnd.choice(ENGLISH + WORDS) for _ in range(50)), "en") for i in range(200)], "doc_id long, text string, lang string")
    model = secrets.train(secrets.labelled_samples(spark, documents))
    df = spark.createDataFrame([(i, f"value {t} end") for i, t in enumerate(keys + plain)], "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.find_secrets(df, model).where(F.size("spans") > 0).select("doc_id").collect()}
    hits = sum(i < len(keys) for i in found)
    assert hits / len(keys) >= 0.95 and hits / len(found) >= 0.95, (hits, len(found))


ENGLISH = (
    "river mountain water forest bridge market village harbour engine window garden letter number picture music kitchen winter summer morning evening person "
    "country school teacher student science history nature animal weather station journey island captain sailor compass lantern anchor morning general private "
    "public simple complex double single change return create remove select insert update delete choose measure compare combine separate collect distribute"
).split()
