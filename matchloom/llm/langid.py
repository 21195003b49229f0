"""Language identification by averaged hashed subword vectors, with calibrated rejection.

Labelled rows come from the documents themselves: about ``config.rows`` of each
language, picked by a hash of the id among rows that ``train_where`` admits.
Everything else covers all rows.  Probabilities are calibrated by a temperature
that held-out training rows set; a prediction whose probability is under
``reject_below`` is marked ``rejected``.

A null text or one without a letter has language ``und`` and score 0.  Null
languages are not learned from.  Without labelled rows all texts are ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import crc_mod, map_batches, texts
from matchloom.llm.subword import Config, Model, train

_LETTER = regex.compile(r"\p{L}")


def sample(docs: DataFrame, label: str, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of each label, those with the smallest hashes of ``key``; labels are few."""
    n = {r[label]: r["count"] for r in docs.groupBy(label).count().collect()}
    share = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    keep = F.lit(False)
    for value, count in n.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (share < int((1 << 30) * min(1, rows / count))))
    return docs.where(keep)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_where: Column | None = None, config: Config = Config()) -> Model:  # noqa: B008
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & (F.char_length("text") <= config.longest))
    if train_where is not None:
        rows = rows.where(train_where)
    found = [(r["text"].lower(), r["lang"]) for r in sample(rows, "lang", "doc_id", config.rows).orderBy("doc_id", "text").toLocalIterator()]
    return train(found, sorted({lang for _, lang in found}), config)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", reject_below: float = 0.5) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""

    def run(batch: pa.RecordBatch):
        text = [x or "" for x in batch.column("text").to_pylist()]
        known = [bool(model.classes and _LETTER.search(x)) for x in text]
        p = model.probabilities([x.lower() if k else "" for x, k in zip(text, known, strict=True)]) if model.classes else np.zeros((len(text), 1))
        best = p.argmax(1)
        score = [round(float(p[i, b]), 9) if known[i] else 0.0 for i, b in enumerate(best)]
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array([model.classes[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()),
                pa.array(score, pa.float64()),
                pa.array([s < reject_below for s in score]),
            ],
            names=["doc_id", "lang_pred", "score", "rejected"],
        )

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(docs_id: Column) -> Column:
    """Rows of query op8_langid that no model learns from."""
    return crc_mod(docs_id, 5) == 0


def query(docs: DataFrame) -> DataFrame:
    """The columns of query op8_langid, and ``rejected``."""
    model = fit(docs, train_where=~held_out(F.col("doc_id")))
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
