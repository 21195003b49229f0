"""Substring deduplication of word windows by super-k-mer partitioning.

A window is ``width`` consecutive words of one document.  Windows that also start
in a document with a smaller id are repeated, and every word that a repeated
window covers is removed; windows are judged on the input.  Consecutive windows
with one minimiser travel as one packed string (see ``windows``), and sorting a
bucket's windows word by word counts them exactly.

A null text has no words.  A null id is larger than all others.  Windows that
repeat within one document, or in rows with one id, stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from matchloom.llm import windows, wordhash
from matchloom.llm.common import texts

def words_of(raw: bytes) -> list[bytes]:
    # bytes.split splits at \x09-\x0D and the space only
    return raw.split()


def _cut(raw: bytes) -> tuple[np.ndarray, bytes, np.ndarray]:
    hashes, start, end = wordhash.words(raw)
    return hashes, b" ".join(words_of(raw)), np.concatenate(([0], np.cumsum(end - start + 1)))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13, anchor: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by spaces), kept_sha256 of every row."""
    return _run(docs, id_col, text_col, width, anchor, True)


def _run(docs: DataFrame, id_col: str, text_col: str, width: int, anchor: int, with_text: bool) -> DataFrame:
    def finish(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
        words = words_of(raw)
        gone = windows.flags(len(words), start, end) if len(start) else None
        kept = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        removed = 0 if gone is None else int(gone.sum())
        text = (kept.decode(),) if with_text else ()
        return (len(words), removed, *text, hashlib.sha256(kept).hexdigest())

    schema = f"doc_id long, n_words long, n_removed long, {'kept string, ' if with_text else ''}kept_sha256 string"
    return windows.covered(texts(docs, id_col, text_col), windows.Tokens(_cut, width, anchor, gap=1), windows.Words(width), finish, schema)


def query(docs: DataFrame) -> DataFrame:
    """The columns of query op2_substring_dedup."""
    return _run(docs, "doc_id", "text", 13, 3, False)
