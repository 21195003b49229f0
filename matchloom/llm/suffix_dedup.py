"""Removal of repeated byte strings by depth-limited radix sort of suffixes.

Suffixes are ordered through their first ``width`` bytes only, by passes over
digits from the most significant on.  The first digit, which deals suffixes to
tasks, is the hash of the smallest-hashed ``anchor``-byte substring of a suffix's
``width`` bytes: suffixes that agree in ``width`` bytes agree in it, and
neighbouring suffixes with one such digit travel as one string (see
``windows``).  Further passes take eight bytes each and drop groups of a single
document; groups that are left after the last are exactly the strings of
``width`` bytes that several documents have.

Every byte covered by a ``width``-byte string that also starts in a document with
a smaller id is removed; strings are judged on the input and never cross
documents.  A null text is empty.  A null id is larger than all others.  Strings
that repeat within one document, or in rows with one id, stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from matchloom.llm import windows
from matchloom.llm.common import texts

_BYTE = windows._mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _cut(raw: bytes) -> tuple[np.ndarray, bytes, None]:
    return _BYTE[np.frombuffer(raw, np.uint8)], raw, None


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50, anchor: int = 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (what stays, broken characters as U+FFFD), kept_sha256 of every row."""
    return _run(docs, id_col, text_col, width, anchor, True)


def _run(docs: DataFrame, id_col: str, text_col: str, width: int, anchor: int, with_text: bool) -> DataFrame:
    def finish(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
        kept, removed, spans = raw, 0, 0
        if len(start):
            gone = windows.flags(len(raw), start, end)
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            removed = int(gone.sum())
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        text = (kept.decode("utf-8", "replace"),) if with_text else ()
        return (len(raw), removed, spans, *text, hashlib.sha256(kept).hexdigest())

    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept string, ' if with_text else ''}kept_sha256 string"
    return windows.covered(texts(docs, id_col, text_col), windows.Tokens(_cut, width, anchor), windows.Bytes(width), finish, schema)


def query(docs: DataFrame) -> DataFrame:
    """The columns of query op9_suffix_dedup."""
    return _run(docs, "doc_id", "text", 50, 20, False)
