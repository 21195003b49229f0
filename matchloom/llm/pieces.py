"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into three transducers:

* ``Normaliser``: the model's character map, white space rules, dummy prefix and
  escaping, from raw to normalised text;
* ``Lexicon``: one arc path per piece, plus byte-fallback arcs for every
  character that no piece spells.  An arc's weight is minus the piece's score
  for unigram models.  For BPE models the states are pieces: after piece ``a``
  an arc ``b`` has weight 1 if merging the characters of ``ab`` by rank ends in
  just ``a, b``, and infinite weight otherwise.  A sequence of pieces all of
  whose neighbours fit is the one that the merges of the whole text end in, so
  the only path of finite weight is the BPE encoding;
* ``Decoder``: the inverse, from ids to text.

Encoding composes normalised input with the lexicon and takes the shortest
path in the tropical semiring.  As no piece has an escaped space after another
character (checked when compiled), paths of the stretches between are
independent: a worker remembers the ids of frequent stretches and what the
decoder makes of them.  New stretches of a batch are composed together: ``paths``
walks all of them through the lexicon at once, an arc length at a time, and then
relaxes the arcs found, end by end.

A null text is empty; an empty text has no ids and decodes to itself; texts of
any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchloom.llm.common import map_batches, texts

SPACE = "▁"
# Piece types and model types of the file format, and the penalty of an unknown character.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Stretches and pairs of pieces that a worker remembers before it starts anew.
_REMEMBER, _LONGEST = 300_000, 48
#: Stretches that are composed together.
_TOGETHER = 1 << 14
#: No text holds this.
_HEAD = "\udfff"
_OUTSIDE = -1  # state before the first piece, and around characters without a piece


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a serialized message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            n = varint()
            yield number, raw[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield number, struct.unpack("<d" if kind == 1 else "<f", raw[at : at + n])[0]
            at += n
        else:
            raise ValueError(f"field {number} has unknown wire type {kind}")


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """Rules of a precompiled character map: a double-array trie of what to replace, then the replacements."""
    if not blob:
        return {}
    size = struct.unpack("<I", blob[:4])[0]
    units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size])
    strings = blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    rules: dict[bytes, bytes] = {}
    open_nodes = [(offset(units[0]), b"")]
    while open_nodes:
        base, prefix = open_nodes.pop()
        for c in range(1, 256):
            node = base ^ c
            if node >= len(units) or units[node] & ((1 << 31) | 255) != c:
                continue
            child = node ^ offset(units[node])
            if units[node] >> 8 & 1:
                value = units[child] & 0x7FFFFFFF
                rules[prefix + bytes([c])] = strings[value : strings.index(b"\0", value)]
            open_nodes.append((child, prefix + bytes([c])))
    return rules


class Normaliser:
    """Raw to normalised text, from left to right: where rules match, the longest one's arcs lead through its
    characters and write its replacement; any other character is an arc to itself."""

    def __init__(self, rules: dict[bytes, bytes], dummy_prefix: bool, squeeze: bool, escape: bool):
        self.dummy_prefix, self.squeeze, self.escape = dummy_prefix, squeeze, escape
        self.rules = {k.decode(): v.decode() for k, v in rules.items()}
        self.root: dict = {}
        for rule, out in self.rules.items():
            node = self.root
            for c in rule:
                node = node.setdefault(c, {})
            node[""] = out
        self.begins = re.compile(f"[{re.escape(''.join(self.root))}]") if rules else None
        #: Whether words are what spaces separate, as they are.
        self.plain = not rules and not squeeze and dummy_prefix and escape

    def _rewritten(self, text: str) -> str:
        out, at = [], 0
        while m := self.begins.search(text, at):
            out.append(text[at : m.start()])
            at = k = m.start()
            node, found, end = self.root, text[at], at + 1
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node:
                    found, end = node[""], k
            out.append(found)
            at = end
        return "".join(out) + text[at:]

    def apply(self, text: str) -> str:
        if self.begins:
            text = self._rewritten(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text


class Table:
    """A map from whole numbers to small ones that many keys are looked up in at once."""

    def __init__(self, items: dict[int, int] | None = None):
        self.bits, self.size = 10, 0
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        if items:
            self.put(np.fromiter(items, np.int64, len(items)), np.fromiter(items.values(), np.int32, len(items)))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (held >= 0)
            todo, slot = todo[more], slot[more] + 1 & (1 << self.bits) - 1
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that differ from each other and from all there are."""
        if 2 * (self.size + len(keys)) > 1 << self.bits:
            old, own = self.keys[self.keys >= 0], self.values[self.keys >= 0]
            while 3 * (self.size + len(keys)) > 1 << self.bits:
                self.bits += 1
            self.keys, self.values, self.size = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32), 0
            self.put(old, own)
        self.size += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], slot[~mine] + 1 & (1 << self.bits) - 1


class Lexicon:
    def __init__(self, raw: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                p = dict(_fields(value))
                pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or any(t == USER_DEFINED for *_, t in pieces) or trainer.get(24):
            raise ValueError("only unigram and BPE models without user-defined pieces or suffix spaces are supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.normaliser = Normaliser(character_map(normaliser.get(2, b"")), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)))
        self.pieces = pieces
        self.id = {p: k for k, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.score = [s for _, s, _ in pieces]
        self.unknown = next((k for k, (*_, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(pieces) if t == BYTE}
        low = min((s for _, s, t in pieces if t == NORMAL), default=0.0)
        self.unknown_weight = UNKNOWN_PENALTY - low
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        self.root: dict = {}
        self._merges: dict[int, tuple[list[float], list[str], list[str]]] = {}
        arcs: dict[int, int] = {}
        last: list[int] = [-1]
        for p, k in self.id.items():
            if self.kind == BPE:
                self._merges[k] = merges = self._merged(p)
                if merges[1][-1] != p:
                    continue
            node, number = self.root, 0
            for c in p:
                node = node.setdefault(c, {})
                if (child := arcs.get(number << 21 | ord(c))) is None:
                    child = arcs[number << 21 | ord(c)] = len(last)
                    last.append(-1)
                number = child
            node[""] = last[number] = k
        #: The lexicon's arcs by state and character, and the piece that ends in a state.
        self.arcs, self.ends = Table(arcs), np.array(last, np.int32)
        self._fits: dict[int, bool] = {}
        self._pairs = Table()
        self._known: dict[str, tuple[bytes, bytes]] = {}
        surface = trainer.get(44, " ⁇ ".encode())
        self.spelled = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else surface if t == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, t in pieces
        ]

    def _merged(self, text: str) -> tuple[list[float], list[str], list[str]]:
        """The merges of a text's neighbours, best score first, leftmost of equals first: their scores, and the first
        and the last part before each and after all."""
        parts, scores, heads, tails = list(text), [], [text[0]], [text[-1]]
        found = [self.id.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best = max(((self.score[k], -i) for i, k in enumerate(found) if k is not None), default=None)
            if best is None:
                return scores, heads, tails
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found[max(i - 1, 0) : i + 2] = [self.id.get(parts[k] + parts[k + 1]) for k in (i - 1, i) if k >= 0 and k + 1 < len(parts)]
            scores.append(best[0])
            heads.append(parts[0])
            tails.append(parts[-1])

    def fits(self, a: int, b: int) -> bool:
        """Whether the arc of piece ``b`` has finite weight in the state after piece ``a``."""
        if self.kind == UNIGRAM or a < 0 or b < 0:
            return True
        known = self._fits.get(a << 32 | b)
        if known is None:
            if len(self._fits) > _REMEMBER:
                self._fits.clear()
            known = self._fits[a << 32 | b] = self._apart(self._merges[a], self._merges[b])
        return known

    def _apart(self, left: tuple, right: tuple) -> bool:
        """Whether two pieces side by side are merged each for itself, and never across their border: of the next
        merge in the left one, across, and in the right one, the best score goes first, the leftmost of equals."""
        none = float("-inf")
        i = k = 0
        while True:
            a = left[0][i] if i < len(left[0]) else none
            b = right[0][k] if k < len(right[0]) else none
            across = self.id.get(left[2][i] + right[1][k])
            if across is not None and (c := self.score[across]) > a and c >= b:
                return False
            if a == b == none:
                return True
            if a >= b:
                i += 1
            else:
                k += 1

    def paths(self, stretches: list[str]) -> list[np.ndarray]:
        """Ids along the shortest path of each stretch, of BPE models with byte fallback; the same as ``path``, for many at once."""
        if not stretches:
            return []
        code = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.array([len(x) for x in stretches])
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(size)), size)
        upto = (first + size)[word]
        # compose: from every character, all at once, one character further through the lexicon
        at, node, k = np.arange(len(code)), np.zeros(len(code), np.int64), 0
        found: list[tuple[np.ndarray, ...]] = []
        while len(at):
            node = self.arcs.get(node << 21 | code[at + k])
            on = node >= 0
            at, node, k = at[on], node[on].astype(np.int64), k + 1
            piece = self.ends[node]
            has = piece >= 0
            found.append((at[has], np.full(int(has.sum()), k), piece[has]))
            if k == 1:
                lost = np.setdiff1d(np.arange(len(code)), at[has])
                found.append((lost, np.full(len(lost), 1), np.full(len(lost), _OUTSIDE, np.int32)))
            on = at + k < upto[at]
            at, node = at[on], node[on]
        start, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        # places between characters: one more than characters in each stretch
        begin = first + np.arange(len(size))
        place = start - first[word[start]] + length
        start = start + word[start]
        end = start + length
        order = np.argsort(place, kind="stable")
        start, end, piece, place = start[order], end[order], piece[order], place[order]
        weight = np.full(len(code) + len(size), np.inf)
        weight[begin] = 0
        arc, before = np.full(len(weight), _OUTSIDE, np.int64), np.full(len(weight), -1)
        edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        for a, b in zip(edge.tolist(), np.concatenate((edge[1:], [len(place)])).tolist(), strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b].astype(np.int64)
            on = weight[s] < np.inf
            s, e, p = s[on], e[on], p[on]
            on = self._finite(arc[s], p)
            s, e, p = s[on], e[on], p[on]
            total = weight[s] + np.where(p >= 0, 1.0, self.unknown_weight)
            np.minimum.at(weight, e, total)
            won = total == weight[e]
            arc[e[won]], before[e[won]] = p[won], s[won]
        # back from the ends
        own, at, steps = np.arange(len(size)), begin + size, []
        while len(own):
            steps.append((own, arc[at], code[at - own - 1]))
            at = before[at]
            on = at > begin[own]
            own, at = own[on], at[on]
        own, ids, code = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True))
        order = np.argsort(own, kind="stable")
        own, ids, code = own[order], ids[order].astype("<i4"), code[order]
        edge = np.searchsorted(own, np.arange(len(size) + 1)).tolist()
        out = [ids[a:b] for a, b in zip(edge, edge[1:], strict=False)]
        for w in np.unique(own[ids < 0]).tolist():
            each = zip(out[w].tolist(), code[edge[w] : edge[w + 1]].tolist(), strict=True)
            out[w] = np.array([i for k, c in each for i in ([k] if k >= 0 else self._spare(chr(c)))], "<i4")
        return out

    def _spare(self, c: str) -> list[int]:
        """The arcs of a character that no piece spells."""
        return [self.bytes[b] for b in c.encode()] if self.byte_fallback else [self.unknown]

    def _finite(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` of pairs of pieces."""
        key = np.where((a >= 0) & (b >= 0), a << 32 | b & 0xFFFFFFFF, -1)
        out = key < 0
        at = np.flatnonzero(~out)
        held = self._pairs.get(key[at])
        new = np.unique(key[at][held < 0])
        if len(new):
            if self._pairs.size > 4 * _REMEMBER:
                self._pairs = Table()
                new = np.unique(key[at])
            values = [self._apart(self._merges[k >> 32], self._merges[k & 0xFFFFFFFF]) for k in new.tolist()]
            self._pairs.put(new, np.array(values, np.int32))
            held = self._pairs.get(key[at])
        out[at] = held > 0
        return out

    def path(self, text: str) -> list[int]:
        """Ids along the shortest path of normalised ``text``.

        One state at most has finite weight at each place: there is but one for
        unigram models, and for BPE models the last piece of the text so far.
        """
        n, root, score, bpe = len(text), self.root, self.score, self.kind == BPE
        allowed, fits = self._fits.get, self.fits
        weight: list[float] = [0.0] + [float("inf")] * n
        arc = [_OUTSIDE] * (n + 1)  # id of the arc that the best path to a place ends with
        before = [-1] * (n + 1)
        for i in range(n):
            if i and before[i] < 0:
                continue
            here, a, node, k, single = weight[i], arc[i], root, i, False
            while k < n:
                node = node.get(text[k])
                if node is None:
                    break
                k += 1
                b = node.get("")
                if b is None:
                    continue
                if k == i + 1:
                    single = True
                if bpe:
                    if before[k] >= 0 or a >= 0 and not (ok if (ok := allowed(a << 32 | b)) is not None else fits(a, b)):
                        continue
                    total = here + 1
                else:
                    total = here - score[b]
                if total < weight[k]:
                    weight[k], arc[k], before[k] = total, b, i
            if not single and here + self.unknown_weight < weight[i + 1]:
                weight[i + 1], arc[i + 1], before[i + 1] = here + self.unknown_weight, _OUTSIDE, i
        out: list[int] = []
        at = n
        while at:
            i = before[at]
            if arc[at] >= 0:
                out.append(arc[at])
            elif self.byte_fallback:
                out += [self.bytes[b] for b in reversed(text[i:at].encode())]
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one piece
                out.append(self.unknown)
            at = i
        return out[::-1]

    def _stretches(self, text: str) -> list[str]:
        """A text's stretches, each without the escaped space that it begins with; ``_HEAD`` is before one that has none."""
        if self.normaliser.plain and SPACE not in text:
            words = text.split(" ")
            if "" not in words:
                return words
        text = self.normaliser.apply(text)
        return [x[1:] if x[0] == SPACE else _HEAD + x for x in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)]

    def encode_all(self, texts_: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as 32-bit numbers, bytes that they decode to) of each text."""
        if not self.splits or not self.byte_fallback:
            ids = [self.path(t) if (t := self.normaliser.apply(x)) else [] for x in texts_]
            return [(np.array(x, "<i4").tobytes(), self._spelled(x)) for x in ids]
        if len(self._known) > _REMEMBER:
            self._known.clear()
        known = self._known
        each = [self._stretches(x) if x else [] for x in texts_]
        new = list(set().union(*each).difference(known))
        full = [x[1:] if x[:1] == _HEAD else SPACE + x for x in new]
        short = [k for k, x in enumerate(full) if self.kind == BPE and len(x) <= _LONGEST]
        ids = {}
        for a in range(0, len(short), _TOGETHER):
            part = short[a : a + _TOGETHER]
            ids.update(zip(part, self.paths([full[k] for k in part]), strict=True))
        for k, x in enumerate(new):
            own = ids[k] if k in ids else np.array(self.path(full[k]), "<i4")
            known[x] = own.tobytes(), b"".join([self.spelled[i] for i in own.tolist()])
        out = []
        for words in each:
            found = [known[w] for w in words]
            back = b"".join([x[1] for x in found])
            out.append((b"".join([x[0] for x in found]), back[1:] if self.normaliser.dummy_prefix and back[:1] == b" " else back))
        for k, x in enumerate(new):
            if len(full[k]) > _LONGEST:
                del known[x]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0][0], "<i4")

    def _spelled(self, ids: list[int]) -> bytes:
        """What the decoder writes: from its first state, the piece that first writes anything leaves out the dummy
        prefix; all others write what they spell."""
        raw = b"".join([self.spelled[k] for k in ids])
        return raw[1:] if self.normaliser.dummy_prefix and raw[:1] == b" " else raw

    def decode(self, ids: list[int]) -> str:
        """Text of ids; byte pieces that form no character become U+FFFD, the dummy prefix goes."""
        return self._spelled(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def compiled(raw: bytes) -> Lexicon:
    return Lexicon(raw)


def default_model() -> str:
    """Path of the public 32,000-piece BPE model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, n_ids, decoded_sha256 (of the text decoded from the ids), round_trip of every row."""
    with open(model_path, "rb") as f:
        raw = f.read()

    def run(batch: pa.RecordBatch):
        lexicon = compiled(raw)
        ids, digests, same = [], [], []
        given = [x or "" for x in batch.column("text").to_pylist()]
        for text, (own, back) in zip(given, lexicon.encode_all(given), strict=True):
            ids.append(own)
            same.append(back == text.encode())
            digests.append(hashlib.sha256(back if same[-1] else back.decode("utf-8", "replace").encode()).hexdigest())
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
        yield pa.record_batch(
            [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(sizes), pa.array(digests), pa.array(same)],
            names=["doc_id", "ids", "n_ids", "decoded_sha256", "round_trip"],
        )

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, ids array<int>, n_ids long, decoded_sha256 string, round_trip boolean")


def decode(rows: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of rows with piece ids; null ids decode to an empty text."""
    with open(model_path, "rb") as f:
        raw = f.read()

    def run(batch: pa.RecordBatch):
        lexicon = compiled(raw)
        text = [lexicon.decode([k for k in ids or [] if k is not None]) for ids in batch.column("ids").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return map_batches(rows.select(rows[id_col].cast("long").alias("doc_id"), rows[ids_col].cast("array<int>").alias("ids")), run, "doc_id long, text string")
