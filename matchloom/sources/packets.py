"""What the payloads of a frame log hold: inner messages, the log's header, game events and string tables.

Nothing here trusts its input: sizes are bounded, and what cannot be read ends with
a warning in its row or is left out; it does not raise.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.formats import MAX_BLOB, fields, frames, varint

# Commands whose payload is a packet, the packet's data field, message types, entries of a table.
PACKETS, DATA_FIELD = (7, 8), 3
CREATE_TABLE, UPDATE_TABLE, EVENT_LIST, EVENT = 44, 45, 205, 207
MAX_ENTRIES, HISTORY = 4096, 32
HEADER_FRAME, FILE_HEADER = 1, 16
HEADER = {3: "server_name", 4: "client_name", 5: "map_name", 6: "game_directory", 11: "version_name", 13: "build_num"}
MESSAGES = "path string, frame_no long, tick long, message_no int, type int, body binary, warning string"
TABLES = "path string, frame_no long, message_no int, table string, entry int, key string, value binary"


class Bits:
    """Numbers from a string of bits, the lowest bit of a byte first; raises EOFError where it ends."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.end = raw, 0, 8 * len(raw)

    def number(self, n: int) -> int:
        if self.at + n > self.end:
            raise EOFError("the bits end")
        first = self.at >> 3
        out = int.from_bytes(self.raw[first : (self.at + n + 7) >> 3], "little") >> (self.at & 7)
        self.at += n
        return out & (1 << n) - 1

    def short(self) -> int:
        """Six bits, of which the upper two say how many more follow above the lower four."""
        low = self.number(6)
        more = (0, 4, 8, 28)[low >> 4]
        return low & 15 | self.number(more) << 4 if more else low

    def varint(self) -> int:
        out = 0
        for shift in range(0, 35, 7):
            b = self.number(8)
            out |= (b & 127) << shift
            if b < 128:
                return out & 0xFFFFFFFF
        raise EOFError("a number of more than five bytes")

    def string(self) -> str:
        out = bytearray()
        while b := self.number(8):
            out.append(b)
        return out.decode("utf-8", "replace")

    def bytes(self, n: int) -> bytes:
        return self.number(8 * n).to_bytes(n, "little")


def unpacked(payload: bytes, compressed: bool) -> bytes:
    """A frame's payload as it was before compression; raises ValueError if it cannot be, or is too large."""
    if not compressed:
        return payload
    try:
        size, _ = varint(payload, 0)
        if size > MAX_BLOB:
            raise ValueError("a payload is larger than the limit")
        return pa.Codec("snappy").decompress(payload, size, asbytes=True)
    except (IndexError, OSError, pa.ArrowException) as e:
        raise ValueError("a compressed payload cannot be read") from e


def values(raw: bytes) -> dict[int, list]:
    """Values of a serialized message by field: whole numbers, raw bytes of strings and messages, bytes of fixed ones."""
    out: dict[int, list] = {}
    for number, kind, start, end in fields(raw):
        out.setdefault(number, []).append(varint64(raw, start) if kind == 0 else raw[start:end])
    return out


def varint64(raw: bytes, at: int) -> int:
    out = shift = 0
    while raw[at] > 127:
        out |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
    return out | raw[at] << shift


def messages(raw: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(type, body, warning) of a packet's messages."""
    bits = Bits(raw)
    while bits.end - bits.at >= 8:
        try:
            kind, size = bits.short(), bits.varint()
            if not 0 < size <= (bits.end - bits.at) // 8:
                raise EOFError
            yield kind, bits.bytes(size), None
        except EOFError:
            yield -1, None, "a packet ends inside a message"
            return


def read_messages(frames_: DataFrame) -> DataFrame:
    """A row for each message of the packets among ``formats.read_frames``."""
    packets = frames_.where(F.col("command").isin(*PACKETS) & F.col("payload").isNotNull()).select("path", "frame_no", "tick", "compressed", "payload")
    names = [c.split(" ")[0] for c in MESSAGES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, frame, tick, compressed, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    data = values(unpacked(payload, compressed)).get(DATA_FIELD, [b""])[0]
                except ValueError as e:
                    rows.append((path, frame, tick, 0, -1, None, str(e)))
                    continue
                rows += [(path, frame, tick, k, *m) for k, m in enumerate(messages(data))]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return packets.mapInArrow(run, MESSAGES)


def probe(spark: SparkSession, path: str) -> DataFrame:
    """path and what the header frame of each log says; nulls where there is none.  Only the first frame is decoded."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = list(HEADER.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {n: [] for n in names}
            for raw in batch.column("content").to_pylist():
                first = next(frames(raw, FILE_HEADER), None)
                try:
                    header = values(unpacked(first[4], first[3])) if first and first[1] == HEADER_FRAME and first[4] is not None else {}
                except ValueError:
                    header = {}
                for number, n in HEADER.items():
                    value = header.get(number, [None])[0]
                    found[n].append(value.decode("utf-8", "replace") if isinstance(value, bytes) else None if value is None else str(value))
            yield pa.record_batch([batch.column("path"), *[pa.array(found[n], pa.string()) for n in names]], names=["path", *names])

    return files.mapInArrow(run, "path string, " + ", ".join(f"{n} string" for n in names))


def event_schema(raw: bytes) -> dict[int, tuple[str, list[str]]]:
    """Names of the events that an event list describes and of their keys, by event id."""
    out = {}
    for one in values(raw).get(1, []):
        event = values(one)
        keys = [values(k).get(2, [b""])[0].decode("utf-8", "replace") for k in event.get(3, [])]
        out[event.get(1, [0])[0]] = event.get(2, [b""])[0].decode("utf-8", "replace"), keys
    return out


def _typed(key: dict[int, list]) -> object:
    """Value of an event's key; its field says its type."""
    for number, of in ((2, lambda v: v.decode("utf-8", "replace")), (3, lambda v: struct.unpack("<f", v)[0]), (4, _signed), (5, _signed), (6, _signed), (7, bool), (8, int)):
        if number in key:
            return of(key[number][0])
    return None


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def events(found: DataFrame) -> DataFrame:
    """path, frame_no, tick, message_no, event, props (a JSON object) of the game events among ``read_messages``,
    by the schema that each log itself describes; an event that it does not describe has a null name."""
    lists = found.where(F.col("type") == EVENT_LIST).groupBy("path").agg(F.max_by("body", F.struct("frame_no", "message_no")).alias("schema"))
    rows = found.where(F.col("type") == EVENT).select("path", "frame_no", "tick", "message_no", "body").join(lists, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, dict] = {}
        for batch in batches:
            names, props = [], []
            for body, schema in zip(batch.column("body").to_pylist(), batch.column("schema").to_pylist(), strict=True):
                schema = known.setdefault(schema, event_schema(schema)) if schema is not None and schema not in known else known.get(schema, {})
                event = values(body)
                name, keys = schema.get(event.get(2, [-1])[0], (None, []))
                given = [_typed(values(k)) for k in event.get(3, [])]
                names.append(name)
                props.append(json.dumps(dict(zip(keys, given, strict=False))))
            rest = [batch.column(c) for c in ("path", "frame_no", "tick", "message_no")]
            yield pa.record_batch([*rest, pa.array(names, pa.string()), pa.array(props, pa.string())], names=["path", "frame_no", "tick", "message_no", "event", "props"])

    return rows.mapInArrow(run, "path string, frame_no long, tick long, message_no int, event string, props string")


class StringTables:
    """The string tables of one log, message by message."""

    def __init__(self):
        self.tables: list[dict] = []

    def create(self, raw: bytes) -> Iterator[tuple[str, int, str, bytes | None]]:
        m = values(raw)
        first = lambda n, d: m.get(n, [d])[0]
        table = {"name": first(1, b"").decode("utf-8", "replace"), "fixed": bool(first(3, 0)), "bits": first(5, 0), "varints": bool(first(10, 0)), "entries": {}}
        self.tables.append(table)
        try:
            yield from self._entries(unpacked(first(7, b""), bool(first(9, 0))), first(2, 0), table)
        except ValueError:
            return

    def update(self, raw: bytes) -> Iterator[tuple[str, int, str, bytes | None]]:
        m = values(raw)
        number = m.get(1, [0])[0]
        if number < len(self.tables):
            yield from self._entries(m.get(3, [b""])[0], m.get(2, [0])[0], self.tables[number])

    def _entries(self, raw: bytes, n: int, table: dict) -> Iterator[tuple[str, int, str, bytes | None]]:
        """Changed entries: index (the next one, or given), key (whole, or with the start of an earlier one), value."""
        bits, at, earlier = Bits(raw), -1, []
        try:
            for _ in range(n):
                at = at + 1 if bits.number(1) else bits.varint() if table["varints"] else bits.number(11)
                if at not in table["entries"] and len(table["entries"]) >= MAX_ENTRIES:
                    return
                key, value = table["entries"].get(at, ("", None))
                if bits.number(1):
                    if bits.number(1):
                        which, size = bits.number(5), bits.number(5)
                        key = (earlier[which][:size] if which < len(earlier) else "") + bits.string()
                    else:
                        key = bits.string()
                    earlier = [*earlier, key][-HISTORY:]
                if bits.number(1):
                    if table["fixed"]:
                        value = bits.number(table["bits"]).to_bytes((table["bits"] + 7) // 8, "little")
                    else:
                        value = bits.bytes(bits.short() if table["varints"] else bits.number(17))
                table["entries"][at] = key, value
                yield table["name"], at, key, value
        except (EOFError, OverflowError):
            return


def string_tables(found: DataFrame) -> DataFrame:
    """Every change of a string table's entry, in the order of a log's messages; ``entity.replay`` makes states of them.

    A log's table messages are decoded together, as a change of a key may refer to earlier ones; they are a small part
    of it.
    """
    rows = found.where(F.col("type").isin(CREATE_TABLE, UPDATE_TABLE) & F.col("body").isNotNull()).select("path", "frame_no", "message_no", "type", "body")
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.binary()]
    names = [c.split(" ")[0] for c in TABLES.split(", ")]

    def run(log: pa.Table) -> pa.Table:
        state, out = StringTables(), []
        for row in log.sort_by([("frame_no", "ascending"), ("message_no", "ascending")]).to_pylist():
            changes = state.create(row["body"]) if row["type"] == CREATE_TABLE else state.update(row["body"])
            out += [(row["path"], row["frame_no"], row["message_no"], *c) for c in changes]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return rows.groupBy("path").applyInArrow(run, TABLES)
