"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gossamer.llm import bpe, decontam, langid, neardup, secrets
from gossamer.llm.common import column, fresh, table
from gossamer.session import ensure_checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what has no letter (null and empty texts among it), or nothing in common with any known language.

    Rows with a null id or language stay if their text is known; repeated rows all do; an empty table stays empty.
    """
    profiles = langid.train(docs)
    lang, score = (fresh(docs.columns, c) for c in ("lang_pred", "score"))
    found = langid.identify(docs, profiles, keep=tuple(docs.columns), lang_col=lang, score_col=score)
    return found.where((column(lang) != langid.UNDETERMINED) & (column(score) > 0)).select(*map(column, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near-copies, one of repeated rows.

    Null ids come last; of a class without ids one text stays. Null and empty texts are copies of each other.
    """
    return neardup.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark. Null and empty texts hold none, null and empty items are in none."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mask; n_chars follows. All rows stay; texts without a secret, null ones too, stay as they are."""
    return secrets.mask(docs, secrets.train(secrets.labelled_samples(spark, docs)))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it exactly. A null or empty text has none; all rows stay."""
    return bpe.tokenized(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe", tokenize),
]

#: Profiles, sketches, alignments and BPE are not expressible in SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again, so that a lost executor costs one stage at most.

    A stage's output is deleted once the next one is complete; the last one is the result.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        written = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = written
    return docs
