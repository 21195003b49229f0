"""Cleaning a corpus of documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the rows that stay; they are
written as Parquet and read again as the next stage's documents.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import decontaminate, jaccard_join, pieces, quality_classifier, secrets
from matchloom.llm.common import read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from all labels."""
    return quality_classifier.keep(docs, quality_classifier.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that Jaccard links connect."""
    return jaccard_join.representatives(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), unnamed=True)


def credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live credentials blotted out and n_chars counted anew."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return pieces.encode(docs, pieces.default_model())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmarks", benchmarks),
    ("credentials", credentials),
    ("encoded", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs


#: A learned classifier and piece ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
