"""A training corpus from ``documents``: quality, duplicates, leaks, mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sondeframe.llm.common import remove_path, scratch_path
from sondeframe.llm.decontaminate import drop_contaminated
from sondeframe.llm.exact_dedup import drop_exact_duplicates
from sondeframe.llm.jaccard_join import drop_near_duplicates
from sondeframe.llm.mixing import labelled_rows, mix
from sondeframe.llm.quality import keep_quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the resampling draws; null and empty texts weigh as texts without n-grams."""
    return keep_quality(docs, _table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the row with the largest id; a row repeated with its id once."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id; texts without words and rows without id stay."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no edited copy of a test item; texts without words hold none."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds rate and copies, by which languages reach their shares; the classifier knows those of labelled documents alone.

    The budget is the least at which no language must shrink, so that clean
    documents are repeated rather than lost.
    """
    return mix(docs, labelled_rows(docs, _table(spark, sf_dir, "labels")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
]

#: The quality model, the alignment and the mixture have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes once the next one is written."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return docs
