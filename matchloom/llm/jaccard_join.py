"""Exact Jaccard join of documents on word shingles, by universe partition and pigeonhole.

Two sets R, S with |R n S| >= s |R u S| differ in at most
``H = (1 - s) / (1 + s) * (|R| + |S|)`` elements.  The universe of 64-bit shingle
hashes is cut into ``m > H`` segments of equal width, where ``H`` is the largest
possible in a *size band* (or across the border of two bands), so a linked pair
agrees in all but ``H`` segments.  A set's signature of each segment that it has
elements in is indexed.  How many units a segment gets is decided by cost, where a
signature that more than ``few`` sets share is *hot* and gets none:

* A set with more than ``H`` cheap signatures meets each partner in one of them.
* A *thin* set, whose elements leave too many segments empty, gets two units from
  each segment: it also indexes the segment's one-deletion neighbourhood, among
  thin sets, which finds segments that differ by one.
* Sets that lack units, as their segments are hot, are cut anew into the narrowest
  segments, of one element each.  Frequencies among these *poor* sets are the cost;
  a set asks with its cheapest elements, just as many as a partner cannot all miss.
  A pair of which one set has cheap elements enough, or that shares any cheap
  element, meets in a cheap element that both ask with.
* What is left are sets that are hot but for a fifth, so nearly all their content is
  their group's.  A pair of them that shares no cheap element can be linked only if
  the smaller hot part alone is enough.  Each is compared with the *lead* of its
  group, the member with the fewest cheap elements; links become components; then
  members outside the group's largest component are compared with those members of
  other components that two bounds leave: that of the hot parts, and that of what the
  two lack of the lead and have beyond it, for what they share is at most the lead,
  less what either lacks, and what both have beyond it (``_may``).

No group is expanded into its pairs: stars join what is alike, and the bounds cut off
what only shares a passage, or differs from its lead in other places than others do.
(Sets of one group that no star reaches, and that the bounds leave as possible, are
compared one by one; none is dropped.)

Candidates are verified on the exact sets.  Documents with equal sets are one node.
Only sets that have a candidate at all are read again: a bitmap of fixed size tells
which texts these may be.  Signatures move as compressed arrays, in a row per (task, slot).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm import wordhash
from matchloom.llm.common import slots, texts, written
from matchloom.llm.windows import _bytes, _mix, _pack, _unpack

_SCHEMA = pa.schema([("slot", pa.int32()), ("body", pa.binary())])
_ROWS = "slot int, body binary"
_LOW = np.uint64(0xFFFFFFFF)
#: Bytes of text whose signatures a task packs together.
_FLUSH = 8 << 20
#: Bits of the map of wanted texts; more texts than bits only make it pass more.
_MAP_BITS = 24
#: Partners that one copy of a text is compared with in one task.
_PARTNERS = 2000
# what a packed row holds, and what a row of the index's results says
SIGNATURES, PAIR, HOT, EACH = 1, 2, 3, 4
_FOUND = "kind int, a long, b long, c long, d long, print binary"
_FOUND_SCHEMA = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("print", pa.binary())])

#: Odd factors of a shingle's words.
_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ^ 0xD6E8FEB86659FD93 * k) % (1 << 64) | 1) for k in range(8)]


def shingles(raw: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words are one shingle, none give none."""
    h, _, _ = wordhash.words(raw, lower=True)
    if not len(h):
        return h
    size = min(size, len(h))
    n = len(h) - size + 1
    key = h[:n] * _ODD[0]
    for k in range(1, size):
        key += h[k : n + k] * _ODD[k % len(_ODD)]
        if k % len(_ODD) == len(_ODD) - 1:
            key = _mix(key)
    key = _mix(key + np.uint64(size))
    key.sort()
    return key[np.concatenate(([True], key[1:] != key[:-1]))]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def bands(percent: int, ratio: float = 1.7, largest: int = 1 << 40) -> list[int]:
    """Lower borders of the size bands; no link spans more than one border."""
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, int(out[-1] * max(ratio, 100 / percent) + 0.999)))
    return out


def schemes(n: int, borders: list[int], percent: int) -> list[tuple[int, int]]:
    """(name, H) of the schemes that a set of ``n`` elements is indexed in: its band's, and those of borders near it."""
    k = int(np.searchsorted(borders, n, "right")) - 1
    differ = lambda total: (100 - percent) * total // (100 + percent)
    out = [(2 * k, differ(2 * (borders[k + 1] - 1)))]
    for j, border in ((k, borders[k]), (k + 1, borders[k + 1])):
        # a pair across the border: below it at most border - 1, above it at most 100 / percent of that
        above = 100 * (border - 1) // percent
        if j and (n >= border and n <= above or n < border and 100 * n >= percent * border):
            out.append((2 * j - 1, differ(border - 1 + above)))
    return out


def signatures(hashes: np.ndarray, scheme: int, h: int) -> tuple[np.ndarray, int, np.ndarray]:
    """(signatures of the non-empty segments, how many more than ``H`` they are, further signatures if they are not)."""
    m = h + 3 + h // 6
    # ranges of the 64-bit universe: segments are neighbours in the sorted set
    segment = ((hashes >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    mixed = _mix(hashes)
    total = np.add.reduceat(mixed, first)
    name = _mix(segment[first].astype(np.uint64) + np.uint64(scheme << 32)) | np.uint64(1)
    own = _mix(total * name + name)
    spare = len(first) - (h + 1)
    if spare >= 0:
        return own, spare, np.empty(0, np.uint64)
    # thin: every segment, empty ones too, and what is left of it without one element
    size = np.diff(np.concatenate((first, [len(hashes)])))
    at = np.repeat(np.arange(len(first)), size)
    without = _mix((total[at] - mixed) * name[at] + name[at])
    empty = np.setdiff1d(np.arange(m), segment[first]).astype(np.uint64)
    blank = _mix(empty + np.uint64(scheme << 32)) | np.uint64(1)
    thin = np.unique(np.concatenate((own, without, _mix(blank))))
    return own, spare, _mix(thin ^ np.uint64(0x5851F42D4C957F2D))


def _fingerprint(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _found(kind: int, a, b, c, d=None, prints=None, none=None) -> pa.Table:
    n = len(a)
    zero = np.zeros(n, np.int64)
    return pa.table(
        [
            pa.array(np.full(n, kind, np.int32)),
            pa.array(a, pa.int64(), mask=none),
            pa.array(b, pa.int64()),
            pa.array(c, pa.int64()),
            pa.array(zero if d is None else d, pa.int64()),
            pa.array(prints, pa.binary()) if prints is not None else pa.nulls(n, pa.binary()),
        ],
        schema=_FOUND_SCHEMA,
    )


class Join:
    """The steps of the join that work on arrays; ``parts`` is a number of slots, not of tasks."""

    #: ``spare`` of signatures that may all be hot, and the largest that is told apart.
    ANY, MOST = 255, 254

    def __init__(self, size: int, percent: int, parts: int, few: int):
        self.size, self.percent, self.parts, self.few = size, percent, parts, few
        self.borders = bands(percent)

    def post(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signatures of each set that a task's documents have, by bucket, and the documents' own rows."""
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, int, int, int, int]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, prints = [], []
            for raw in _bytes(batch.column("text")):
                own = shingles(raw, self.size)
                f = _fingerprint(own) if len(own) else bytes(16)
                sizes.append(len(own))
                prints.append(f)
                size += len(raw)
                if len(own) and f not in seen:
                    seen.add(f)
                    node = int.from_bytes(f[:8], "little")
                    for name, h in schemes(len(own), self.borders, self.percent):
                        if not h:
                            continue  # equal sets only, and these are one node
                        exact, more, thin = signatures(own, name, h)
                        held.append((exact, node, self.ANY if more < 0 else min(more, self.MOST), name, len(own)))
                        if len(thin):
                            held.append((thin, node, 0, name, len(own)))
                if size > _FLUSH:
                    yield self._posted(held)
                    seen, held, size = set(), [], 0
            ids = batch.column("doc_id")
            body = _pack(
                kind=np.array([EACH], np.uint8),
                doc=np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64),
                none=np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8),
                size=np.array(sizes, np.int64),
                key=np.asarray(batch.column("key").to_numpy(zero_copy_only=False), np.int64),
                prints=np.frombuffer(b"".join(prints), np.uint8),
            )
            yield pa.record_batch([pa.array([int.from_bytes(xxhash.xxh32_digest(body), "little") % self.parts], pa.int32()), pa.array([body], pa.binary())], schema=_SCHEMA)
        if held:
            yield self._posted(held)

    def _posted(self, held: list) -> pa.RecordBatch:
        if not held:
            return pa.record_batch([pa.array([], pa.int32()), pa.array([], pa.binary())], schema=_SCHEMA)
        sig = np.concatenate([x[0] for x in held]) >> np.uint64(12)
        many = [len(x[0]) for x in held]
        each = lambda k, kind: np.repeat(np.array([x[k] for x in held], kind), many)
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        columns = {n: each(k, t)[order] for n, k, t in (("node", 1, np.uint64), ("spare", 2, np.uint8), ("scheme", 3, np.uint8), ("size", 4, np.uint32))}
        bucket = ((sig >> np.uint64(20)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        mark = np.array([SIGNATURES], np.uint8)
        rows = []
        for a, b in zip(edge.tolist(), np.concatenate((edge[1:], [len(sig)])).tolist(), strict=True):
            # differences of sorted signatures have few high bytes
            rows.append(_pack(kind=mark, step=np.diff(sig[a:b], prepend=np.uint64(0)), **{k: v[a:b] for k, v in columns.items()}))
        return pa.record_batch([pa.array(bucket[edge].astype(np.int32)), pa.array(rows, pa.binary())], schema=_SCHEMA)

    def meet(self, table: pa.Table) -> pa.Table:
        """Pairs of cheap signatures, and how many hot ones each set has in each scheme."""
        out, rows = [_FOUND_SCHEMA.empty_table()], []
        for body in table.column("body").to_pylist():
            x = _unpack(body)
            if x["kind"][0] == SIGNATURES:
                rows.append((np.cumsum(x["step"], dtype=np.uint64), x["node"], x["spare"], x["scheme"], x["size"]))
                continue
            raw = x["prints"].tobytes()
            prints = [raw[16 * k : 16 * k + 16] if n else None for k, n in enumerate(x["size"].tolist())]
            node = x["prints"].reshape(-1, 16)[:, :8].copy().view(np.int64).ravel()
            out.append(_found(EACH, x["doc"], x["size"], node, x["key"], prints, x["none"] > 0))
        if rows:
            sig, node, spare, scheme, size = (np.concatenate(c) for c in zip(*rows, strict=True))
            del rows
            # what is alone in its signature has no partner
            order = np.argsort(sig, kind="stable")
            sig = sig[order]
            same = sig[1:] == sig[:-1]
            kept = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
            sig, order = sig[kept], order[kept]
            node, spare, scheme, size = node[order], spare[order], scheme[order], size[order].astype(np.int64)
            order = np.lexsort((node, sig))
            sig, node, spare, scheme, size = sig[order], node[order], spare[order], scheme[order], size[order]
            kept = np.ones(len(sig), bool)
            kept[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node, spare, scheme, size = sig[kept], node[kept], spare[kept], scheme[kept], size[kept]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.empty(0, np.int64)
            count = np.diff(np.concatenate((first, [len(sig)])))
            hot = np.repeat(count > self.few, count)
            pairs = []
            cheap = np.flatnonzero(~hot)
            for d in range(1, self.few):
                i = cheap[cheap + d < len(sig)]
                i = i[sig[i] == sig[i + d]]
                i = i[100 * np.minimum(size[i], size[i + d]) >= self.percent * np.maximum(size[i], size[i + d])]
                pairs.append((node[i], node[i + d]))
            a, b = np.concatenate([p[0] for p in pairs]).view(np.int64), np.concatenate([p[1] for p in pairs]).view(np.int64)
            if len(a):
                a, b = np.unique(np.stack((a, b)), axis=1)
                out.append(_found(PAIR, a, b, np.zeros(len(a), np.int64)))
            if hot.any():
                own = np.stack((node[hot].view(np.int64), scheme[hot].astype(np.int64) << 8 | spare[hot]))
                own, many = np.unique(own, axis=1, return_counts=True)
                out.append(_found(HOT, own[0], own[1], many))
        return pa.concat_tables(out)

    def fetch(self, batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sets of the texts that the map lets pass, with one text of each."""
        seen: set[bytes] = set()
        for batch in batches:
            key = np.asarray(batch.column("key").to_numpy(zero_copy_only=False), np.int64).view(np.uint64) & np.uint64((1 << _MAP_BITS) - 1)
            at = np.flatnonzero(wanted[(key >> np.uint64(3)).astype(np.int64)] >> (key & np.uint64(7)).astype(np.uint8) & 1)
            prints, raws, sizes = [], [], []
            for raw in _bytes(batch.column("text").take(pa.array(at))):
                own = shingles(raw, self.size)
                if len(own) and (f := _fingerprint(own)) not in seen:
                    seen.add(f)
                    prints.append(f)
                    raws.append(raw)
                    sizes.append(len(own))
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.record_batch([pa.array(prints, pa.binary()), pa.array(raws, pa.binary()), pa.array(sizes, pa.int64())], names=["print", "raw", "n"])

    def elements(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(raw, self.size) for raw in batch.column("raw").to_pylist()]
            if not sets:
                continue
            at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            yield pa.record_batch([batch.column("print").take(pa.array(at)), batch.column("n").take(pa.array(at)), pa.array(np.concatenate(sets).view(np.int64))], names=["print", "n", "element"])

    def send(self, sets: pa.Table, pairs: pa.Table) -> pa.Table:
        """The texts of the pairs' first sets to the slots of the second ones."""
        raws = dict(zip(sets.column("print").to_pylist(), sets.column("raw").to_pylist(), strict=True))
        to = pairs.column("to").to_numpy()
        order = np.argsort(to, kind="stable")
        a, b = pairs.column("a").take(pa.array(order)).to_pylist(), pairs.column("b").take(pa.array(order)).to_pylist()
        to = to[order]
        edge = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.empty(0, np.int64)
        rows = []
        for x, y in zip(edge.tolist(), np.concatenate((edge[1:], [len(to)])).tolist(), strict=False):
            place = {p: k for k, p in enumerate(dict.fromkeys(a[x:y]))}
            text = [raws[p] for p in place]
            rows.append(
                _pack(
                    own=np.frombuffer(b"".join(place), np.uint8),
                    length=np.array([len(t) for t in text], np.int64),
                    text=np.frombuffer(b"".join(text), np.uint8),
                    at=np.array([place[p] for p in a[x:y]], np.uint32),
                    b=np.frombuffer(b"".join(b[x:y]), np.uint8),
                )
            )
        return pa.table([pa.array(to[edge].astype(np.int32)), pa.array(rows, pa.binary())], schema=_SCHEMA)

    def verify(self, sets: pa.Table, sent: pa.Table) -> pa.Table:
        """What the sets of each pair share, and whether that is enough."""
        raws = dict(zip(sets.column("print").to_pylist(), sets.column("raw").to_pylist(), strict=True))
        known: dict[bytes, np.ndarray] = {}
        a, b, both, enough, size = [], [], [], [], 0
        for body in sent.column("body").to_pylist():
            x = _unpack(body)
            raw, end = x["text"].tobytes(), np.cumsum(x["length"])
            own, second = x["own"].tobytes(), x["b"].tobytes()
            other: dict[int, np.ndarray] = {}
            for i, k in enumerate(x["at"].tolist()):
                right = second[16 * i : 16 * i + 16]
                if (left_set := other.get(k)) is None:
                    left_set = other[k] = shingles(raw[end[k] - x["length"][k] : end[k]], self.size)
                if (right_set := known.get(right)) is None:
                    right_set = shingles(raws[right], self.size)
                    size += len(right_set)
                    if size > 4_000_000:
                        known, size = {}, len(right_set)
                    known[right] = right_set
                a.append(own[16 * k : 16 * k + 16])
                b.append(right)
                both.append(overlap(left_set, right_set))
                enough.append(100 * both[-1] >= self.percent * (len(left_set) + len(right_set) - both[-1]))
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(both, pa.int64()), pa.array(enough, pa.bool_())], names=["a", "b", "both", "linked"])


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of every node with a link, by alternating stars."""
    edges = written(links.where("a <> b").distinct())
    while True:
        # large star: larger neighbours of a node go to its smallest neighbour
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours of a node, and the node, go to the smallest
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = written(
            large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        # done when only stars are left: every node has one smaller neighbour, which has none
        centres = edges.select(F.col("b").alias("centre")).distinct()
        again = edges.groupBy("a").agg(F.count("*").alias("n")).join(centres, F.col("a") == F.col("centre"), "left").where("n > 1 or centre is not null")
        if again.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(centres.select("centre", "centre"))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A map of ``_MAP_BITS`` bits of the keys' last bits, made by words of 64 bits; its size does not depend on the keys."""
    word = F.shiftright(F.col("key").bitwiseAND((1 << _MAP_BITS) - 1), 6).cast("int")
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    out = np.zeros(1 << (_MAP_BITS - 6), np.int64)
    for at, bits in keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        out[at] = bits
    return out.view(np.uint8)


def _verified(pairs: DataFrame, sets: DataFrame, j: Join) -> DataFrame:
    """a, b, both, linked of the pairs: what they share, and whether it is enough.  ``a`` may have any number of partners: beyond ``_PARTNERS`` its
    text is sent from several slots; ``b`` should have few."""
    salts = pairs.groupBy(F.col("a").alias("print")).agg(F.ceil(F.count("*") / _PARTNERS).alias("salts"))
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(j.parts)).cast("int")
    first = sets.join(salts, "print").select("print", "raw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    first = first.select(slot("print", "salt").alias("slot"), "print", "raw")
    asked = pairs.join(salts.withColumnRenamed("print", "a"), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    asked = asked.select(slot("a", "salt").alias("slot"), slot("b").alias("to"), "a", "b")
    sent = first.groupBy("slot").cogroup(asked.groupBy("slot")).applyInArrow(lambda x, y: j.send(x, y), _ROWS)
    second = sets.join(pairs.select(F.col("b").alias("print")).distinct(), "print", "left_semi").select(slot("print").alias("slot"), "print", "raw")
    return second.groupBy("slot").cogroup(sent.groupBy("slot")).applyInArrow(lambda x, y: j.verify(x, y), "a binary, b binary, both long, linked boolean")


def _near_size(j: Join, x: str, y: str):
    return 100 * F.least(x, y) >= j.percent * F.greatest(x, y)


def _asks(sets: DataFrame, j: Join) -> DataFrame:
    """print, n, rare, element, count: of each poor set its cheapest elements, as many as a partner cannot all miss, as
    far as other poor sets have them; ``rare``: elements of the set that are not hot."""
    each = sets.select("print", "n", "raw").mapInArrow(j.elements, "print binary, n long, element long")
    shared = each.groupBy("element").agg(F.count("*").alias("count")).where("count > 1")
    by_set = each.join(shared, "element").groupBy("print", "n").agg(F.sort_array(F.collect_list(F.struct("count", "element"))).alias("e"))
    alone = F.col("n") - F.size("e")
    hot = F.size(F.filter("e", lambda s: s["count"] > j.few))
    need = F.col("n") - F.floor((F.col("n") * j.percent + 99) / 100) + 1 - alone
    by_set = by_set.select("print", "n", (F.col("n") - hot).alias("rare"), F.slice("e", F.lit(1), F.greatest(need, F.lit(0)).cast("int")).alias("e"))
    return by_set.select("print", "n", "rare", F.explode("e").alias("e")).select("print", "n", "rare", "e.element", "e.count")


def _cheap_pairs(asks: DataFrame, j: Join) -> DataFrame:
    """Pairs that ask with one cheap element; it has ``few`` sets at most."""
    cheap = asks.where(F.col("count") <= j.few)
    x, y = (cheap.select("element", F.col("print").alias(p), F.col("n").alias(n)) for p, n in (("a", "na"), ("b", "nb")))
    return x.join(y, "element").where((F.col("a") < F.col("b")) & _near_size(j, "na", "nb")).select("a", "b")


def _leads(asks: DataFrame, j: Join) -> DataFrame:
    """element, lead, n_lead, rare_lead: of each hot element's sets the one with the fewest rare elements."""
    hot = asks.where(F.col("count") > j.few)
    low = hot.groupBy("element").agg(F.min(F.struct("rare", "print", "n")).alias("s"))
    return low.select("element", F.col("s.print").alias("lead"), F.col("s.n").alias("n_lead"), F.col("s.rare").alias("rare_lead"))


def _stars(asks: DataFrame, leads: DataFrame, j: Join) -> DataFrame:
    """Each set that asks with a hot element, and the element's lead."""
    return asks.join(leads, "element").where((F.col("lead") != F.col("print")) & _near_size(j, "n_lead", "n")).select(F.col("lead").alias("a"), F.col("print").alias("b"))


def _rest(asks: DataFrame, leads: DataFrame, shared: DataFrame, labels: DataFrame, j: Join) -> DataFrame:
    """Pairs of sets of different components that ask with one hot element, and that no bound excludes.

    Only sets outside an element's largest component ask.  Of a pair, ``a`` is that with fewer rare elements.
    ``shared``: what leads share with their members (lead, print, both).
    """
    p, whole = j.percent, 100 + j.percent
    hot = asks.join(leads, "element").where("print <> lead").join(shared, ["lead", "print"], "left").join(labels.withColumnRenamed("node", "print"), "print", "left")
    core = F.col("n") - F.col("rare")
    # what the lead has and the set lacks; what the set has beyond the lead, and how much of that may be hot
    hot = hot.select(
        "element", "print", "n", "rare", "n_lead", core.alias("core"), F.coalesce("label", "print").alias("label"),
        (F.col("n_lead") - F.col("both")).alias("lacks"),
        (F.col("n") - F.col("both")).alias("more"),
        F.least(F.col("n") - F.col("both"), core - F.col("both") + F.least("rare", "rare_lead")).alias("more_hot"),
    )
    # bounds of what any partner may give: its hot part is as large as one's own at most, and the most that the group's members offer
    hot = hot.where(whole * F.col("core") >= 2 * p * F.col("core") + p * F.col("rare"))
    offer = hot.groupBy("element").agg(F.max(p * (F.col("lacks") - F.col("more")) + whole * F.col("more_hot")).alias("most"), F.count_if(F.col("lacks").isNull()).alias("unknown"))
    hot = hot.join(offer, "element").where((F.col("unknown") > 0) | (100 * F.col("lacks") + p * F.col("more") <= (100 - p) * F.col("n_lead") + F.col("most"))).drop("most", "unknown")
    by_label = hot.groupBy("element", "label").agg(F.count("*").alias("sets"))
    largest = by_label.groupBy("element").agg(F.max(F.struct("sets", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    hot = hot.join(largest.select("element", F.col("most.label").alias("most")), "element")
    x = hot.where("label <> most").select("element", *[F.col(c).alias(f"{c}_x") for c in ("print", "n", "rare", "core", "label", "lacks", "more", "more_hot")])
    both = x.join(hot, "element").where(F.col("label") != F.col("label_x")).where(_may(j))
    low = F.struct("rare", "print") < F.struct(F.col("rare_x").alias("rare"), F.col("print_x").alias("print"))
    return both.select(F.when(low, F.col("print")).otherwise(F.col("print_x")).alias("a"), F.when(low, F.col("print_x")).otherwise(F.col("print")).alias("b")).distinct()


def _may(j: Join):
    """Whether a pair that shares no cheap element may be linked.

    With ``s`` of what both lack of the lead, and ``t`` of what both have beyond it, they share
    ``n_lead - lacks - lacks_x + s + t``, and their union is ``n_lead + more + more_x - s - t``.
    """
    p, whole = j.percent, 100 + j.percent
    core = whole * F.least("core", "core_x") >= p * (F.col("n") + F.col("n_x"))
    apart = 100 * (F.col("lacks") + F.col("lacks_x")) + p * (F.col("more") + F.col("more_x"))
    shared = whole * (F.least("lacks", "lacks_x") + F.least("more_hot", "more_hot_x"))
    known = F.col("lacks").isNotNull() & F.col("lacks_x").isNotNull()
    return core & (~known | (apart <= (100 - p) * F.col("n_lead") + shared))


def classes(docs: DataFrame, *, size: int = 5, percent: int = 80, few: int = 8) -> DataFrame:
    """doc_id, n_shingles, key, print, label of every row of (doc_id, text).

    ``key``: xxhash64 of the text; ``print``: 128-bit hash of the set, null if empty; ``label``: the smallest print
    that links reach.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    j = Join(size, percent, slots(docs), few)
    posted = docs.mapInArrow(j.post, _ROWS)
    found = written(posted.groupBy("slot").applyInArrow(lambda t: j.meet(t), _FOUND))
    each = found.where(F.col("kind") == EACH).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("node"), F.col("d").alias("key"), "print")
    node = each.where("print is not null").groupBy("print").agg(F.min("key").alias("key"), F.first("node").alias("node"))
    pairs = found.where(F.col("kind") == PAIR).select("a", "b").distinct()
    hot = found.where(F.col("kind") == HOT).groupBy("a", "b").agg(F.sum("c").alias("hot"))
    poor = hot.where(((F.col("b") % 256) != j.ANY) & (F.col("hot") > F.col("b") % 256)).select(F.col("a").alias("node")).distinct()
    known = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(poor).distinct()
    wanted = written(node.join(known, "node").join(poor.withColumn("poor", F.lit(True)), "node", "left"))
    bits = _bitmap(wanted)
    fetched = docs.mapInArrow(lambda batches: j.fetch(batches, bits), "print binary, raw binary, n long").dropDuplicates(["print"])
    sets = written(fetched.join(wanted.select("print", "poor"), "print"))
    first, second = (wanted.select(F.col("node").alias(c), F.col("print").alias(f"{c}_print")) for c in ("a", "b"))
    pairs = pairs.join(first, "a").join(second, "b").select(F.col("a_print").alias("a"), F.col("b_print").alias("b"))

    asks = written(_asks(sets.where("poor"), j))
    leads = written(_leads(asks, j))
    pairs = written(pairs.union(_cheap_pairs(asks, j)).union(_stars(asks, leads, j)).distinct())
    judged = written(_verified(pairs, sets, j))
    labels = written(components(judged.where("linked").select("a", "b")))
    shared = judged.select(F.col("a").alias("lead"), F.col("b").alias("print"), "both")
    rest = written(_rest(asks, leads, shared, labels, j))
    more = written(_verified(rest, sets, j).where("linked").select("a", "b")) if not rest.isEmpty() else rest
    if not more.isEmpty():
        old = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = written(components(more.union(old)))
    each = each.join(labels.withColumnRenamed("node", "print"), "print", "left")
    return each.select("doc_id", "n_shingles", "key", "print", F.coalesce("label", "print").alias("label"))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, few: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Documents link when 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles.
    component_id: the smallest id that links reach.  A document without words has an empty set, links with nothing
    and is its own component; a null id counts only where no other reaches it, and is then null.
    """
    each = classes(texts(docs, id_col, text_col), size=size, percent=percent, few=few)
    lowest = each.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component"))
    return each.join(lowest, "label", "left").select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document of each group of linked ones: that with the smallest
    id (nulls last), of several texts with that id the one with the smallest hash.

    Rows with equal id and text are one document; of rows that differ in other columns only, the one with the smallest
    hash of all columns stays.  A document without words stays.
    """
    each = classes(texts(docs, id_col, text_col), **options)
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    stay = each.where("label is not null").groupBy("label").agg(F.min(name).alias("s")).select("s.doc_id", "s.key")
    stay = stay.union(each.where("label is null").select("doc_id", "key")).distinct().select(F.col("doc_id").alias("stay"), F.col("key").alias("stay_key"))
    # the row as one column, so that no name of it can clash
    text = docs[text_col].cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("key"))
    rows = rows.join(stay, rows["id"].eqNullSafe(stay["stay"]) & (rows["key"] == stay["stay_key"]), "left_semi")
    # maps cannot be hashed
    plain = [F.col("row")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    same = Window.partitionBy("id", "key").orderBy(F.xxhash64(*plain))
    return rows.withColumn("copy", F.row_number().over(same)).where("copy = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])
