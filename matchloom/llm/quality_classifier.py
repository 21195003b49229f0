"""Quality classifier on learned hashed word and character n-gram vectors.

About ``config.rows`` labelled rows of each class, picked by a hash of the id,
train the model on the driver; every whole text is scored.  Labels, language,
source and id are no inputs of a score.

A null text counts as empty; texts without words get the score of the model's
bias.  A document with several labels trains once with each.  Without labelled
rows every score is 0.5.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import crc_mod, filter_batches, give_back, map_batches, texts
from matchloom.llm.langid import sample
from matchloom.llm.subword import Config, Model, train

CONFIG = Config(pairs=True, ngrams=(2, 3))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_where: Column | None = None, config: Config = CONFIG) -> Model:
    marked = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if train_where is not None:
        marked = marked.where(train_where)
    # a label said twice counts once, so what is sent along has ``rows`` of each class at most
    picked = sample(marked.distinct(), "label", "doc_id", config.rows)
    rows = texts(docs, id_col, text_col).where(F.char_length("text") <= config.longest).join(F.broadcast(picked), "doc_id")
    # of several texts with one id that with the smallest hash
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    model = train(((r["text"], r["label"]) for r in rows.orderBy("doc_id", "text", "label").toLocalIterator()), [0, 1], config)
    give_back(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, score of every row; score: the probability of label 1."""

    def run(batch: pa.RecordBatch):
        p = model.probabilities([x or "" for x in batch.column("text").to_pylist()])[:, 1]
        yield pa.record_batch([batch.column("doc_id"), pa.array(p.round(9))], names=["doc_id", "score"])

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``."""
    return filter_batches(docs, lambda batch: model.probabilities([x or "" for x in batch.column(text_col).to_pylist()])[:, 1] >= least)


def held_out(doc_id: Column) -> Column:
    """Rows of query op5_quality whose labels no model learns."""
    return crc_mod(doc_id, 3) == 1


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op5_quality."""
    model = fit(docs, labels, train_where=~held_out(F.col("doc_id")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
