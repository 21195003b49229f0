"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` consecutive words (an item
with fewer words is one window).  A document holds a window exactly if it holds
all of the window's ``shingle``-word shingles at the right distances, so one
shingle - a prefix of length 1 in an order by corpus rarity - is enough to find
every occurrence:

1. count each benchmark shingle over the whole corpus,
2. keep the rarest shingle of each window as its prefix token, with its offset,
3. join the documents' shingles with those tokens, drop pairs whose window
   would start before or end after the document (length and positional bound),
4. compare the remaining pairs word by word.

The benchmark travels to the tasks only in parts of at most ``part_bytes``
bytes of text; a larger benchmark is joined part by part, and the parts' hits
are brought together by document.

Nulls and empty texts have no words; an item without words has no window;
an item without an id is left out, or with ``unnamed``, as in the query and the
pipeline, its windows are hits like any other, but no item is counted or listed
for them; repeated items with one id count once; repeated documents are judged each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import filter_batches, map_batches, raw_bytes, texts

#: Bytes of a word: digits, small letters and all of a non-ASCII character; A-Z become small.
_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text: lower-cased A-Z, 0-9, and non-ASCII characters."""
    # \x80-\xff bytes never are white space for bytes.split
    return raw.translate(_WORD).split()


def _keys(ids: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit key of the ``length`` ids from each position on."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    key = np.full(n, length, np.uint64)
    for k in range(length):
        key = (key ^ ids[k : k + n].astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    return key


@dataclass
class Windows:
    """Windows of one part of the benchmark, in ids of its own vocabulary (0: no word of it)."""

    vocabulary: dict[bytes, int]
    ids: list[np.ndarray]
    items: list[list[str]]
    shingle: int

    @classmethod
    def build(cls, rows: list[tuple[str | None, bytes]], window: int, shingle: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, raw in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(raw)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).update([] if item is None else [item])
        return cls(vocabulary, [np.array(w, np.int64) for w in found], [sorted(x) for x in found.values()], shingle)

    def shingles(self) -> dict[int, np.ndarray]:
        """Distinct shingle keys by shingle length; a window shorter than a shingle is one itself."""
        out: dict[int, list[np.ndarray]] = {}
        for w in self.ids:
            n = min(self.shingle, len(w))
            out.setdefault(n, []).append(_keys(w, n))
        return {n: np.unique(np.concatenate(x)) for n, x in out.items()}

    def index(self, counts: dict[tuple[int, int], int]) -> Prefixes:
        """Each window under its rarest shingle."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, w in enumerate(self.ids):
            n = min(self.shingle, len(w))
            keys = _keys(w, n)
            at = min(range(len(keys)), key=lambda i: (counts.get((n, int(keys[i])), 0), i))
            by.setdefault(n, []).append((int(keys[at]), at, k))
        lengths = np.array([len(w) for w in self.ids], np.int64)
        padded = np.zeros((len(self.ids), max(lengths, default=1)), np.int64)
        for k, w in enumerate(self.ids):
            padded[k, : len(w)] = w
        tokens = {}
        for n, rows in by.items():
            rows.sort()
            tokens[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        return Prefixes(self.vocabulary, padded, lengths, self.items, tokens)


@dataclass
class Prefixes:
    """Windows by prefix token: for each shingle length the sorted keys, offsets and window numbers."""

    vocabulary: dict[bytes, int]
    padded: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]
    tokens: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def search(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every occurrence in documents laid end to end; ``ends``: of each position's document."""
        starts, windows = [], []
        for n, (keys, offsets, numbers) in self.tokens.items():
            own = _keys(ids, n)
            lo = np.searchsorted(keys, own, "left")
            hit = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == own) & (ids[: len(own)] > 0))
            if not len(hit):
                continue
            lo, hi = lo[hit], np.searchsorted(keys, own[hit], "right")
            # all windows of a token, for every place of the token
            count = hi - lo
            at = np.repeat(hit, count)
            entry = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            start, window = at - offsets[entry], numbers[entry]
            size = self.lengths[window]
            # positional and length bound: the whole window lies in the document of its token
            fits = (start >= 0) & (start + size <= ends[at])
            fits &= ends[np.maximum(start, 0)] == ends[at]
            start, window, size = start[fits], window[fits], size[fits]
            width = np.arange(self.padded.shape[1])
            for k in range(0, len(start), 1 << 16):
                s, w, z = start[k : k + (1 << 16)], window[k : k + (1 << 16)], size[k : k + (1 << 16)]
                place = np.minimum(s[:, None] + width, len(ids) - 1)
                same = ((ids[place] == self.padded[w]) | (width >= z[:, None])).all(1)
                starts.append(s[same])
                windows.append(w[same])
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(starts), np.concatenate(windows)


def _laid_out(batch: pa.RecordBatch, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all documents end to end, and each document's number of words."""
    ids: list[int] = []
    sizes = []
    get = vocabulary.get
    for raw in raw_bytes(batch.column("text")):
        words = words_of(raw)
        sizes.append(len(words))
        ids += [get(w, 0) for w in words]
    return np.array(ids, np.int64), np.array(sizes, np.int64)


def _counts(docs: DataFrame, windows: Windows) -> dict[tuple[int, int], int]:
    """Occurrences in the corpus of every shingle of the benchmark; as many rows as the benchmark has shingles."""
    shingles, vocabulary = windows.shingles(), windows.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(len(keys), np.int64) for n, keys in shingles.items()}
        for batch in batches:
            ids, sizes = _laid_out(batch, vocabulary)
            last = np.repeat(np.cumsum(sizes), sizes)
            for n, keys in shingles.items():
                own = _keys(ids, n)
                # a shingle that crosses into the next document is none
                own = own[(np.arange(len(own)) + n <= last[: len(own)]) & (ids[: len(own)] > 0)]
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                total[n] += np.bincount(at[keys[at] == own], minlength=len(keys))
        for n, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.record_batch(
                [pa.array([n] * len(some), pa.int32()), pa.array(shingles[n][some].view(np.int64)), pa.array(counts[some])],
                names=["n", "shingle", "count"],
            )

    rows = docs.mapInArrow(run, "n int, shingle long, count long").groupBy("n", "shingle").agg(F.sum("count").alias("count"))
    return {(r["n"], r["shingle"] % (1 << 64)): r["count"] for r in rows.collect()}


def _hits(docs: DataFrame, index: Prefixes) -> DataFrame:
    """doc_id, text_key, n_words, hits (word positions), items of every document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, sizes = _laid_out(batch, index.vocabulary)
        end = np.cumsum(sizes)
        ends = np.repeat(end, sizes)
        start, window = index.search(ids, ends)
        n = len(sizes)
        covered = np.zeros(len(ids) + 1, np.int64)
        np.add.at(covered, start, 1)
        np.add.at(covered, start + index.lengths[window], -1)
        places = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        doc = np.repeat(np.arange(n), sizes)
        items: list[set[str]] = [set() for _ in range(n)]
        for d, w in set(zip(doc[start].tolist(), window.tolist(), strict=True)):
            items[d].update(index.items[w])
        first = end - sizes
        hits = [[] for _ in range(n)]
        for p in places.tolist():
            hits[doc[p]].append(p)
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(sizes),
                pa.array([[p - f for p in x] for x, f in zip(hits, first.tolist(), strict=True)], pa.list_(pa.int64())),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ],
            names=["doc_id", "text_key", "n_words", "hits", "items"],
        )

    return map_batches(docs, run, "doc_id long, text_key long, n_words long, hits array<long>, items array<string>")


def _indexes(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, shingle: int, part_bytes: int, unnamed: bool) -> list[Prefixes]:
    """Prefix tokens of each part of the benchmark."""
    bench = benchmark.select(
        benchmark[item_col].cast("string").alias("item"), benchmark[item_text_col].cast("string").alias("text")
    ).where("text is not null" if unnamed else "item is not null and text is not null")
    size = bench.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-2 * size // part_bytes)) if size > part_bytes else 1
    if parts > 1:
        bench = bench.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    out = []
    for k in range(parts):
        rows = bench.where(F.col("part") == k) if parts > 1 else bench
        windows = Windows.build([(r["item"], r["text"].encode()) for r in rows.toLocalIterator()], window, shingle)
        out.append(windows.index(_counts(docs, windows) if windows.ids else {}))
    return out


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 5,
    part_bytes: int = 32 << 20,
    unnamed: bool = False,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of the benchmark."""
    own = docs.select(docs[text_col].cast("string").alias("text"))
    for index in _indexes(own, benchmark, item_col, item_text_col, window, shingle, part_bytes, unnamed):

        def free(batch: pa.RecordBatch, index: Prefixes = index) -> list[bool]:
            ids, sizes = _laid_out(pa.record_batch([batch.column(text_col)], names=["text"]), index.vocabulary)
            start, _ = index.search(ids, np.repeat(np.cumsum(sizes), sizes))
            hit = set(np.repeat(np.arange(len(sizes)), sizes)[start].tolist())
            return [k not in hit for k in range(len(sizes))]

        docs = filter_batches(docs, free)
    return docs


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 5,
    part_bytes: int = 32 << 20,
    unnamed: bool = False,
) -> DataFrame:
    """doc_id, text_key, n_words, hits array<long> (positions of the hit words), items array<string> of each document."""
    docs = texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    found = [_hits(docs, index) for index in _indexes(docs, benchmark, item_col, item_text_col, window, shingle, part_bytes, unnamed)]
    parts = len(found)
    if parts == 1:
        return found[0]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    # repeated rows with one id and text get one row each again
    out = out.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count("*") / parts).cast("int").alias("copies"),
    )
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def digest(hits: DataFrame) -> DataFrame:
    """The columns of query op7_decontaminate."""
    return hits.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def brute_force(documents: list[tuple[int, str | None]], items: list[tuple[str, str | None]], window: int = 10) -> dict:
    """doc_id -> (n_words, n_hit, n_items, items_sha256), by trying every window at every place."""
    windows = []
    for item, text in items:
        words = words_of((text or "").encode())
        windows += [(item, words[k : k + window]) for k in range(max(1, len(words) - window + 1) if words else 0)]
    out = {}
    for doc, text in documents:
        words = words_of((text or "").encode())
        hit, found = set(), set()
        for item, w in windows:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    found.update([] if item is None else [item])
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out
