"""From raw documents to a training mix: toxic documents go, one document of each group of
near duplicates stays, documents with benchmark items go, personal values become pseudonyms,
and the sources are mixed to their target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mopup.llm.decontaminate import decontaminate
from mopup.llm.mixing import apply_mix
from mopup.llm.ngram_join import deduplicate
from mopup.llm.pii import key_of, pseudonymize
from mopup.llm.queries import workers_find_package
from mopup.llm.toxicity import drop_toxic, train
from mopup.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, trained on ``labels``, doesn't call toxic.

    Null and empty texts stay; repeated rows are judged alike; without labelled rows of both kinds, or without documents,
    nothing is called toxic."""
    return drop_toxic(docs, train(docs, _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by word shingles.

    Documents without words are linked with nothing and stay; rows that repeat an id are one document, and rows without an
    id are linked with nothing; an empty table stays empty."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``.

    Null and empty texts stay; null, empty and very short items are found nowhere, so an empty ``benchmark`` keeps all."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal values, by the session's key.

    Every row stays; null and empty texts stay as they are, and equal values become equal pseudonyms in all rows."""
    return pseudonymize(docs, key=key_of(spark), counts=None)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the number of the copy (``copy``, from 1).

    Texts without words are taken 0 times; a null source is a source of its own; repeated rows are drawn each for
    itself; an empty table stays empty.  ``documents`` may not have a column ``copy``."""
    return apply_mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("mixing", mixing),
]

#: No SQL can express the trained model, the edit matching or the random rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
