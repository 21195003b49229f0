"""Exact search for token windows that documents share, the engine of both substring operators.

A document is a sequence of tokens; a window is ``width`` consecutive ones.  A
window's minimiser is its ``anchor``-token substring with the smallest hash, so
equal windows have equal minimisers, and consecutive windows mostly share one.

1. *Anchors.*  Each document's distinct minimisers go to buckets as packed
   arrays of (hash, document).  Minimisers of one document only are dropped.
2. *Super-k-mers.*  A maximal run of windows with one minimiser, if it survived,
   travels as one packed string to its bucket.
3. A bucket drops windows whose 64-bit hash only one document has, orders the others
   digit by digit, the most significant first, and drops groups of one document
   after every pass.  What is equal after the last digit is equal token by token.
   In each group, the windows of all but the smallest document are repeated.
4. The token ranges that repeated windows cover go back to their documents.

Everything that moves is an array compressed per (task, bucket), so rows are few.
What many documents of one task share is settled there: equal anchors and equal
packed strings leave a task once, whatever number of documents hold them.
Documents move by id, in ``parts`` of equal share; buckets hold shares of the anchors.

Long documents are cut into stretches that overlap by ``width - 1`` tokens, so
memory does not grow with a document's windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import wordhash
from matchloom.llm.common import NO_ID, slots, texts

_mix = wordhash.mix
#: Tokens handled at once, tokens whose anchors a task packs together, longest run of windows in one string.
_STRETCH, _FLUSH, _RUN = 1 << 20, 1 << 23, 256
#: Bits of a hash that name an anchor in step 1; more anchors than documents share survive if they agree in these.
_BITS = 48
_SCHEMA = pa.schema([("slot", pa.int32()), ("body", pa.binary())])
_ROWS = "slot int, body binary"


@dataclass(frozen=True)
class Tokens:
    """How texts are cut: ``cut`` gives a text's token hashes, canonical bytes, and the token starts in these
    (None: every byte is a token); ``gap`` bytes separate tokens."""

    cut: Callable[[bytes], tuple[np.ndarray, bytes, np.ndarray | None]]
    width: int
    anchor: int
    gap: int = 0


def _over(x: np.ndarray, n: int, join: Callable[[np.ndarray, np.ndarray], np.ndarray], same: bool) -> np.ndarray:
    """``join`` of every ``n`` neighbours by doubling; ``same``: overlapping halves do no harm."""
    out, size = x, 1
    rest = n
    while size * 2 <= n:
        out = join(out[: len(out) - size], out[size:])
        size *= 2
    rest = n - size
    if rest and same:
        out = join(out[: len(out) - rest], out[rest:])
    elif rest:
        tail = _over(x, rest, join, same)
        out = join(out[: len(x) - n + 1], tail[size : size + len(x) - n + 1])
    return out


def _rolled(x: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every ``n`` neighbours, by doubling."""
    factor = lambda k: np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
    levels, size = {1: x}, 1
    while size * 2 <= n:
        half = levels[size]
        levels[2 * size] = half[: len(half) - size] * factor(size) + half[size:]
        size *= 2
    out, done = levels[size], size
    for k in sorted(levels, reverse=True):
        if done + k <= n:
            m = len(x) - done - k + 1
            out, done = out[:m] * factor(k) + levels[k][done : done + m], done + k
    return out


def minimisers(hashes: np.ndarray, t: Tokens) -> np.ndarray:
    """The minimiser hash of every window of a token sequence."""
    if len(hashes) < t.width:
        return np.empty(0, np.uint64)
    grams = _mix(_rolled(hashes, t.anchor))
    return _over(grams, t.width - t.anchor + 1, np.minimum, True)


def _runs(mins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run with one minimiser."""
    first = np.flatnonzero(np.concatenate(([True], mins[1:] != mins[:-1])))
    size = np.diff(np.concatenate((first, [len(mins)])))
    if len(size) and size.max() > _RUN:
        parts = -(-size // _RUN)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + k * _RUN, np.minimum(_RUN, np.repeat(size, parts) - k * _RUN)
    return first, size


def _stretches(n: int, t: Tokens) -> Iterator[tuple[int, int]]:
    """Token ranges that hold every window of ``n`` tokens once."""
    at = 0
    while n - at >= t.width:
        end = min(n, at + _STRETCH)
        yield at, end
        at = end - t.width + 1


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, bytes of equal weight side by side."""
    head, body = [], []
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        head.append(f"{name} {x.dtype.str} {len(x)}")
        body.append(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) and x.dtype.itemsize > 1 else x.tobytes())
    raw = ("\n".join(head) + "\n\n").encode() + b"".join(body)
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(packed: bytes) -> dict[str, np.ndarray]:
    raw = pa.Codec("zstd").decompress(packed[4:], int.from_bytes(packed[:4], "little"), asbytes=True)
    at = raw.index(b"\n\n") + 2
    out = {}
    for line in raw[: at - 2].decode().split("\n"):
        name, kind, n = line.split(" ")
        kind, n = np.dtype(kind), int(n)
        x = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        out[name] = x if kind.itemsize == 1 else np.ascontiguousarray(x.reshape(kind.itemsize, n).T).view(kind).reshape(n)
    return out


def _dealt(slot: np.ndarray, **arrays: np.ndarray) -> pa.RecordBatch:
    """A row for each slot, with its share of the arrays in their order."""
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    arrays = {k: v[order] for k, v in arrays.items()}
    edge = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.empty(0, np.int64)
    end = np.concatenate((edge[1:], [len(slot)]))
    rows = [_pack(**{k: v[a:b] for k, v in arrays.items()}) for a, b in zip(edge.tolist(), end.tolist(), strict=False)] if len(slot) else []
    return pa.record_batch([pa.array(slot[edge].astype(np.int32)), pa.array(rows, pa.binary())], schema=_SCHEMA)


def _split(sorted_: np.ndarray) -> np.ndarray:
    """Group numbers of a sorted array."""
    return np.cumsum(np.concatenate(([0], (sorted_[1:] != sorted_[:-1]).astype(np.int64)))) if len(sorted_) else np.empty(0, np.int64)


def _several(group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row's group has more than one document, and the group's smallest document."""
    if not len(group):
        return np.empty(0, bool), doc
    if (group[1:] >= group[:-1]).all():
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.concatenate((first, [len(group)])))
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        return np.repeat(low != high, size), np.repeat(low, size)
    n = int(group.max()) + 1
    low = np.full(n, NO_ID, np.int64)
    high = np.full(n, -NO_ID - 1, np.int64)
    np.minimum.at(low, group, doc)
    np.maximum.at(high, group, doc)
    return low[group] != high[group], low[group]


def _part(doc: np.ndarray, parts: int) -> np.ndarray:
    """The part that a document belongs to."""
    with np.errstate(over="ignore"):
        return (_mix(_mix(doc.view(np.uint64)) + np.uint64(1)) % np.uint64(parts)).astype(np.int64)


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Minimisers are small hashes; hashed again they are dealt evenly."""
    return ((_mix(anchor) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NO_ID).to_numpy(zero_copy_only=False), np.int64)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _anchors_of(raw: bytes, t: Tokens) -> np.ndarray:
    hashes, _, _ = t.cut(raw)
    found = [minimisers(hashes[a:b], t) for a, b in _stretches(len(hashes), t)]
    if not found:
        return np.empty(0, np.uint64)
    found = np.concatenate(found)
    # only where a run begins: far fewer to sort
    return np.unique(found[np.concatenate(([True], found[1:] != found[:-1]))] >> np.uint64(64 - _BITS))


def _anchor_rows(t: Tokens, buckets: int, parts: int) -> Callable:
    """Step 1, map side.  Slots: buckets, then parts of documents whose anchors are known to survive."""

    def flush(anchors: list[np.ndarray], docs: list[int]) -> pa.RecordBatch:
        anchor = np.concatenate(anchors)
        doc = np.repeat(np.array(docs, np.int64), [len(a) for a in anchors])
        order = np.argsort(anchor, kind="stable")
        anchor, doc = anchor[order], doc[order]
        group = _split(anchor)
        several, _ = _several(group, doc)
        first = np.concatenate(([True], group[1:] != group[:-1]))
        sent = first  # one row of each anchor; known: it has further documents in this task
        slot = np.concatenate((_bucket(anchor[sent], buckets), buckets + _part(doc[several], parts)))
        return _dealt(
            slot,
            anchor=np.concatenate((anchor[sent], anchor[several])),
            doc=np.concatenate((doc[sent], doc[several])),
            known=np.concatenate((several[sent], np.ones(several.sum(), bool))).view(np.uint8),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, docs, size = [], [], 0
        for batch in batches:
            for doc, raw in zip(_ids(batch.column("doc_id")).tolist(), _bytes(batch.column("text")), strict=True):
                found = _anchors_of(raw, t)
                if len(found):
                    anchors.append(found)
                    docs.append(doc)
                    size += len(raw)
                if size > _FLUSH:
                    yield flush(anchors, docs)
                    anchors, docs, size = [], [], 0
        if anchors:
            yield flush(anchors, docs)

    return run


def _survivors(buckets: int, parts: int) -> Callable:
    """Step 1, bucket side: (anchor, document) of anchors that several documents hold, by the documents' parts."""

    def run(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        rows = [_unpack(x) for x in table.column("body").to_pylist()]
        if slot >= buckets:
            return _all(pa.record_batch([pa.array([slot - buckets], pa.int32()), pa.array([_joined(rows, ("anchor", "doc"))], pa.binary())], schema=_SCHEMA))
        anchor, doc, known = (np.concatenate([r[k] for r in rows]) for k in ("anchor", "doc", "known"))
        order = np.argsort(anchor, kind="stable")
        anchor, doc, known = anchor[order], doc[order], known[order]
        group = _split(anchor)
        several, _ = _several(group, doc)
        sure = np.zeros(int(group.max()) + 1, bool)
        sure[group[known > 0]] = True
        # documents of a task that knows its anchor survives are on their way already
        keep = (several | sure[group]) & (known == 0)
        return _all(_dealt(_part(doc[keep], parts), anchor=anchor[keep], doc=doc[keep]))

    return run


def _joined(rows: list[dict[str, np.ndarray]], names: tuple[str, ...]) -> bytes:
    return _pack(**{k: np.concatenate([r[k] for r in rows]) for k in names})


def _all(*batches: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_batches(batches, schema=_SCHEMA)


def _tag(raw: bytes) -> int:
    """Tells apart documents with one id and different texts."""
    import xxhash

    return xxhash.xxh32_intdigest(raw)


def _gather(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of the ranges, end to end."""
    total = int(size.sum())
    if not total:
        return np.empty(0, np.uint8)
    step = np.ones(total, np.int64)
    end = np.cumsum(size)
    step[0] = start[0]
    step[end[:-1]] = start[1:] - (start[:-1] + size[:-1] - 1)
    return source[np.cumsum(step)]


def _super_kmers(t: Tokens, buckets: int, parts: int) -> Callable:
    """Step 2: packed strings of a part's surviving anchors.  Slots: buckets, then parts for ranges that are settled."""

    def run(docs: pa.Table, survivors: pa.Table) -> pa.Table:
        rows = [_unpack(x) for x in survivors.column("body").to_pylist()]
        if not rows or not docs.num_rows:
            return _all()
        anchor, doc = (np.concatenate([r[k] for r in rows]) for k in ("anchor", "doc"))
        order = np.lexsort((anchor, doc))
        anchor, doc = anchor[order], doc[order]
        out: dict[tuple[int, bytes], list[tuple[int, int, int, int]]] = {}
        batches = []
        held = 0
        ids, raws = _ids(docs.column("doc_id").combine_chunks()), docs.column("text")
        lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
        for k in np.flatnonzero(hi > lo).tolist():
            raw = (raws[k].as_py() or "").encode()
            wanted, tag, number = anchor[lo[k] : hi[k]], _tag(raw), int(ids[k])
            hashes, canonical, starts = t.cut(raw)
            for a, b in _stretches(len(hashes), t):
                mins = minimisers(hashes[a:b], t)
                first, size = _runs(mins)
                own = mins[first] >> np.uint64(64 - _BITS)
                at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                hit = wanted[at] == own
                first, size, own = first[hit] + a, size[hit], own[hit]
                last = first + size + t.width - 1
                if starts is None:
                    left, right = first, last
                else:
                    left, right = starts[first], starts[last] - t.gap
                for f, n, x, y, h in zip(first.tolist(), size.tolist(), left.tolist(), right.tolist(), own.tolist(), strict=True):
                    out.setdefault((h, canonical[x:y]), []).append((number, tag, f, n))
                    held += 1
                if held > 400_000:
                    batches.append(_strings(out, t, buckets, parts))
                    out, held = {}, 0
        if out:
            batches.append(_strings(out, t, buckets, parts))
        return _all(*batches)

    return run


def _strings(found: dict, t: Tokens, buckets: int, parts: int) -> pa.RecordBatch:
    """One row of each packed string, for its smallest document; the string's windows are repeated in all larger ones."""
    anchors, strings, heads, settled = [], [], [], []
    for (anchor, string), held in found.items():
        low = min(held)[0]
        for one in held:
            if one[0] == low:
                anchors.append(anchor)
                strings.append(string)
                heads.append(one)
            else:
                settled.append(one)
    heads_, settled_ = np.array(heads, np.int64).reshape(-1, 4), np.array(settled, np.int64).reshape(-1, 4)
    anchor = np.array(anchors, np.uint64)
    slot = _bucket(anchor, buckets)
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    edge = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    rows = []
    for a, b in zip(edge.tolist(), np.concatenate((edge[1:], [len(slot)])).tolist(), strict=True):
        pick = order[a:b]
        text = [strings[i] for i in pick.tolist()]
        h = heads_[pick]
        rows.append(
            _pack(
                anchor=anchor[pick],
                doc=h[:, 0],
                tag=h[:, 1].astype(np.uint32),
                first=h[:, 2].astype(np.uint32),
                count=h[:, 3].astype(np.uint16),
                size=np.array([len(s) for s in text], np.uint32),
                text=np.frombuffer(b"".join(text), np.uint8),
            )
        )
    done = _dealt(
        buckets + _part(settled_[:, 0].copy(), parts),
        doc=settled_[:, 0],
        tag=settled_[:, 1].astype(np.uint32),
        start=settled_[:, 2],
        end=settled_[:, 2] + settled_[:, 3] + t.width - 1,
    )
    mine = pa.record_batch([pa.array(slot[edge].astype(np.int32)), pa.array(rows, pa.binary())], schema=_SCHEMA)
    return pa.Table.from_batches([mine, done]).combine_chunks().to_batches()[0]


def repeated(digit: Callable[[int, np.ndarray], np.ndarray], digits: int, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Windows that a smaller document has too.

    ``digit(d, rows)``: digit ``d`` of the windows ``rows``; ``group``: of windows that may be equal, at first.
    Each pass orders what is left of a group by one digit more and drops groups of a single document.  A group
    whose windows have one digit is in order as it is, so only those that a digit parts are sorted.
    """
    rows = np.arange(len(doc)) if (group[1:] >= group[:-1]).all() else np.argsort(group, kind="stable")
    group = group[rows]
    for d in range(-1, digits):
        if d >= 0:
            value = digit(d, rows)
            apart = value[1:] != value[:-1]
            odd = apart & (group[1:] == group[:-1])
            if not odd.any():
                continue
            parted = np.zeros(int(group[-1]) + 1, bool)
            parted[group[1:][odd]] = True
            at = np.flatnonzero(parted[group])
            order = at[np.lexsort((value[at], group[at]))]
            rows[at], value[at] = rows[order], value[order]
            group = np.cumsum(np.concatenate(([0], ((group[1:] != group[:-1]) | (value[1:] != value[:-1])).astype(np.int64))))
        several, _ = _several(group, doc[rows])
        rows, group = rows[several], _split(group[several])
        if not len(rows):
            return rows
    _, low = _several(group, doc[rows])
    return rows[doc[rows] > low]


def _judge(t: Tokens, kind: Bytes | Words, buckets: int, parts: int) -> Callable:
    """Step 3: token ranges of the repeated windows of a bucket, by part."""

    def run(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        rows = [_unpack(x) for x in table.column("body").to_pylist()]
        if slot >= buckets:
            return _all(pa.record_batch([pa.array([slot - buckets], pa.int32()), pa.array([_joined(rows, ("doc", "tag", "start", "end"))], pa.binary())], schema=_SCHEMA))
        x = {k: np.concatenate([r[k] for r in rows]) for k in ("anchor", "doc", "tag", "first", "count", "size", "text")}
        del rows
        # the packed strings of an anchor that only one document has left say nothing
        order = np.argsort(x["anchor"], kind="stable")
        several, _ = _several(_split(x["anchor"][order]), x["doc"][order])
        pick = order[several]
        starts = np.cumsum(x["size"].astype(np.int64)) - x["size"]
        sizes, count = x["size"].astype(np.int64), x["count"].astype(np.int64)
        # windows whose hash only one document has are no candidates; a bounded number is looked at at once
        hashes, strings, places = [], [], []
        for part in _portions(pick, count[pick]):
            string, inside = _each(count[part])
            hashes.append(kind.hashes(x["text"], starts[part], sizes[part], string, inside))
            strings.append(part[string].astype(np.int32))
            places.append(inside.astype(np.uint16))
        out = []
        if hashes:
            hash_, string, place = np.concatenate(hashes), np.concatenate(strings), np.concatenate(places)
            del hashes, strings, places
            order = _again(hash_)
            group = _split(hash_[order])
            several, _ = _several(group, x["doc"][string[order]])
            order, group = order[several], group[several]
            string, place = string[order], place[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, np.int64)
            # groups of equal hashes stay together
            for few in _portions(np.arange(len(first)), np.diff(np.concatenate((first, [len(group)])))):
                a, b = int(first[few[0]]), int(first[few[-1] + 1]) if few[-1] + 1 < len(first) else len(group)
                digit, digits = kind.digits(x["text"], starts, sizes, string[a:b], place[a:b])
                hit = repeated(digit, digits, group[a:b] - group[a], x["doc"][string[a:b]]) + a
                if len(hit):
                    hit = hit[np.lexsort((place[hit], string[hit]))]
                    w, k = string[hit], place[hit]
                    new = np.concatenate(([True], (w[1:] != w[:-1]) | (k[1:] != k[:-1] + 1)))
                    begin, end = np.flatnonzero(new), np.concatenate((np.flatnonzero(new)[1:], [len(hit)])) - 1
                    own = w[begin]
                    at = x["first"][own].astype(np.int64)
                    out.append(_dealt(_part(x["doc"][own], parts), doc=x["doc"][own], tag=x["tag"][own], start=at + k[begin], end=at + k[end] + t.width))
        return _all(*out)

    return run


def _again(x: np.ndarray) -> np.ndarray:
    """Places of the values found twice or more, in the order of the values.

    Values alone sort much faster than places; a small table of the repeated ones' last bits finds nearly all places.
    """
    found = np.sort(x)
    found = found[1:][found[1:] == found[:-1]]
    if not len(found):
        return np.empty(0, np.int64)
    found = found[np.concatenate(([True], found[1:] != found[:-1]))]
    last = np.uint64((1 << 20) - 1)
    marked = np.zeros(1 << 20, bool)
    marked[found & last] = True
    at = np.flatnonzero(marked[x & last])
    place = np.minimum(np.searchsorted(found, x[at]), len(found) - 1)
    same = found[place] == x[at]
    at, place = at[same], place[same]
    return at[np.argsort(place, kind="stable")]


def _portions(rows: np.ndarray, weight: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in portions of about a million in weight, at least one row each."""
    if len(rows):
        number = np.cumsum(weight) // 1_000_000
        yield from np.split(rows, np.flatnonzero(number[1:] != number[:-1]) + 1)


def _each(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and place of each of the strings' windows."""
    string = np.repeat(np.arange(len(count)), count)
    return string, np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)


class Bytes:
    """Windows of bytes.  Digits: eight bytes each, the last ones overlapping."""

    def __init__(self, width: int):
        self.width = width
        self.value = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    def hashes(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, string: np.ndarray, inside: np.ndarray) -> np.ndarray:
        rolled = _rolled(self.value[_gather(text, start, size)], self.width)
        return _mix(rolled[(np.cumsum(size) - size)[string] + inside])

    def digits(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, string: np.ndarray, inside: np.ndarray) -> tuple[Callable, int]:
        # eight bytes from any place on; whole windows are read, so none ends behind the text
        words = np.lib.stride_tricks.as_strided(text[: len(text) - len(text) % 8].view(np.uint64), (max(0, len(text) - 7),), (1,), writeable=False)
        at = start[string] + inside
        return lambda d, rows: words[at[rows] + min(8 * d, self.width - 8)], -(-self.width // 8)


class Words:
    """Windows of words.  Digits: words numbered as they come, two to a digit."""

    def __init__(self, width: int):
        self.width = width

    def hashes(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, string: np.ndarray, inside: np.ndarray) -> np.ndarray:
        # a space after each string, so that it ends its last word
        spaced = np.full(int(size.sum()) + len(size), 32, np.uint8)
        spaced[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = _gather(text, start, size)
        hashes, begin, _ = wordhash.words(spaced.tobytes())
        first = np.searchsorted(begin, np.cumsum(size + 1) - (size + 1))
        return _mix(_rolled(hashes, self.width)[first[string] + inside])

    def digits(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, string: np.ndarray, inside: np.ndarray) -> tuple[Callable, int]:
        part, string = np.unique(string, return_inverse=True)
        start, size = start[part], size[part]
        number: dict[bytes, int] = {}
        ids: list[int] = []
        first = []
        for s, n in zip(start.tolist(), size.tolist(), strict=True):
            first.append(len(ids))
            ids += [number.setdefault(w, len(number)) for w in text[s : s + n].tobytes().split(b" ")]
        words = np.array(ids, np.uint64)
        at = np.array(first, np.int64)[string] + inside

        def digit(d: int, rows: np.ndarray) -> np.ndarray:
            k = min(2 * d, self.width - 2)
            return words[at[rows] + k] << np.uint64(32) | words[at[rows] + k + 1]

        return digit, -(-self.width // 2)


def covered(docs: DataFrame, t: Tokens, kind: Bytes | Words, finish: Callable, schema: str) -> DataFrame:
    """A row for each document, made by ``finish(raw text, starts, ends)`` from the token ranges that
    windows cover which start in a document with a smaller id, too.

    ``docs``: doc_id, text.  A null id counts as larger than all others.
    """
    docs = texts(docs)
    parts = slots(docs)
    buckets = parts
    names = [c.split(" ")[0] for c in schema.split(", ")]
    anchors = docs.mapInArrow(_anchor_rows(t, buckets, parts), _ROWS)
    survivors = anchors.groupBy("slot").applyInArrow(_survivors(buckets, parts), _ROWS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(_part(_ids(b.column("doc_id")), parts).astype(np.int32)), b.column("doc_id"), b.column("text")], names=["slot", "doc_id", "text"])

    # one exchange serves both steps that need the texts
    spread = docs.mapInArrow(dealt, "slot int, doc_id long, text string")
    strings = spread.groupBy("slot").cogroup(survivors.groupBy("slot")).applyInArrow(_super_kmers(t, buckets, parts), _ROWS)
    ranges = strings.groupBy("slot").applyInArrow(_judge(t, kind, buckets, parts), _ROWS)

    def close(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows = [_unpack(x) for x in found.column("body").to_pylist()]
        at: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if rows:
            doc, tag, start, end = (np.concatenate([r[k] for r in rows]) for k in ("doc", "tag", "start", "end"))
            place = np.lexsort((start, tag, doc))
            doc, tag, start, end = doc[place], tag[place], start[place], end[place]
            edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))))
            for a, b in zip(edge.tolist(), np.concatenate((edge[1:], [len(doc)])).tolist(), strict=True):
                at[int(doc[a]), int(tag[a])] = (start[a:b], end[a:b])
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        out = []
        for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
            raw = (text or "").encode()
            hit = at.get((NO_ID if doc is None else doc, _tag(raw)), none) if at else none
            out.append((doc, *finish(raw, *hit)))
        kinds = {"long": pa.int64(), "string": pa.string()}
        return pa.table([pa.array([r[k] for r in out], kinds[c.split(" ")[1]]) for k, c in enumerate(schema.split(", "))], names=names)

    return spread.groupBy("slot").cogroup(ranges.groupBy("slot")).applyInArrow(close, schema)


def flags(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` tokens the ranges cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:n]) > 0
