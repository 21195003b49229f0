"""Logs written bit by bit, and what is read back."""

import json
import struct

import pyarrow as pa
import pytest

from matchloom.operators import entity
from matchloom.sources import formats, packets


class _Writer:
    def __init__(self):
        self.bits = []

    def number(self, x, n):
        self.bits += [x >> k & 1 for k in range(n)]
        return self

    def short(self, x):
        if x < 16:
            return self.number(x, 6)
        for flag, more in ((1, 4), (2, 8), (3, 28)):
            if x < 1 << 4 + more:
                return self.number(x & 15 | flag << 4, 6).number(x >> 4, more)

    def raw(self, x):
        for b in x:
            self.number(b, 8)
        return self

    def done(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _packet(*messages):
    w = _Writer()
    for kind, body in messages:
        w.short(kind).raw(_varint(len(body))).raw(body)
    return _field(3, w.done())


def _frame(command, tick, payload, compressed=False):
    if compressed:
        payload = pa.Codec("snappy").compress(payload, asbytes=True)
    return _varint(command | (0x40 if compressed else 0)) + _varint(tick) + _varint(len(payload)) + payload


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("logs")
    head = b"PBDEMS2\0" + bytes(8) + _frame(1, 0, _field(3, "server é") + _field(5, "de_place") + _field(13, 9876))
    event = lambda i, *keys: _field(2, i) + b"".join(_field(3, k) for k in keys)
    key = lambda name, kind: _field(3, _field(1, kind) + _field(2, name))
    schema = _field(1, _field(1, 7) + _field(2, "kill") + key("who", 4) + key("how", 1) + key("far", 2)) + _field(1, _field(1, 300) + _field(2, "end"))
    w = _Writer()
    w.number(1, 1).number(1, 1).number(0, 1).raw(b"player_one\0").number(1, 1).short(3).raw(b"abc")
    w.number(1, 1).number(1, 1).number(1, 1).number(0, 5).number(7, 5).raw(b"two\0").number(0, 1)
    w.number(0, 1).raw(_varint(9)).number(1, 1).number(0, 1).raw(b"far\0").number(1, 1).short(0)
    create = _field(1, "users") + _field(2, 3) + _field(7, pa.Codec("snappy").compress(w.done(), asbytes=True)) + _field(9, 1) + _field(10, 1)
    w = _Writer()
    w.number(1, 1).number(0, 1).number(1, 1).short(20).raw(bytes(range(20)))
    update = _field(1, 0) + _field(2, 1) + _field(3, w.done())
    whole = head + _frame(8, 1, _packet((205, schema), (44, create)), True)
    whole += _frame(7, 5, _packet((207, event(7, _field(1, 4) + _field(4, -3), _field(1, 1) + _field(2, "ß"), _field(1, 2) + _field(3, 1.5))), (45, update)))
    whole += _frame(7, 6, _packet((207, event(300)), (207, event(8))), True) + _frame(2, 7, b"skip")
    (out / "a.log").write_bytes(whole)
    broken = head + _frame(7, 2, _packet((4, b"xy"))[:-1]) + _frame(7 | 0x40, 3, _varint(50) + b"\xff\xff\xff") + _frame(7 | 0x40, 4, _varint(1 << 27) + b"x")
    (out / "b.log").write_bytes(broken)
    (out / "c.log").write_bytes(b"\x01")
    return str(out)


def test_messages(spark, logs):
    rows = packets.read_messages(formats.read_frames(spark, logs, 16)).orderBy("path", "frame_no", "message_no").collect()
    got = [(r["path"][-5], r["frame_no"], r["tick"], r["message_no"], r["type"]) for r in rows if r["warning"] is None]
    assert got == [("a", 1, 1, 0, 205), ("a", 1, 1, 1, 44), ("a", 2, 5, 0, 207), ("a", 2, 5, 1, 45), ("a", 3, 6, 0, 207), ("a", 3, 6, 1, 207)]
    bad = [(r["path"][-5], r["warning"]) for r in rows if r["warning"]]
    assert [b for b, _ in bad] == ["b"] * len(bad) and {w for _, w in bad} >= {"a compressed payload cannot be read", "a payload is larger than the limit"}


def test_probe(spark, logs):
    got = {r["path"][-5]: (r["server_name"], r["map_name"], r["build_num"], r["client_name"]) for r in packets.probe(spark, logs).collect()}
    assert got == {"a": ("server é", "de_place", "9876", None), "b": ("server é", "de_place", "9876", None), "c": (None, None, None, None)}


def test_events(spark, logs):
    rows = packets.events(packets.read_messages(formats.read_frames(spark, logs, 16))).orderBy("frame_no", "message_no").collect()
    assert [(r["event"], json.loads(r["props"])) for r in rows] == [("kill", {"who": -3, "how": "ß", "far": 1.5}), ("end", {}), (None, {})]


def test_string_tables(spark, logs):
    found = packets.string_tables(packets.read_messages(formats.read_frames(spark, logs, 16)))
    rows = found.orderBy("frame_no", "entry").collect()
    assert [(r["table"], r["entry"], r["key"], r["value"] and bytes(r["value"])) for r in rows] == [
        ("users", 0, "player_one", b"abc"), ("users", 1, "player_two", None), ("users", 9, "far", b""), ("users", 0, "player_one", bytes(range(20))),
    ]
    last = entity.replay(found.withColumn("seq", found["frame_no"] * 1000 + found["message_no"]), ["path", "table", "entry"], "seq", "value")
    assert {r["entry"]: r["value"] and bytes(r["value"]) for r in last.collect()} == {0: bytes(range(20)), 1: None, 9: b""}


def test_limits():
    full = packets.StringTables()
    w = _Writer()
    for _ in range(5000):
        w.number(1, 1).number(0, 1).number(0, 1)
    assert len(list(full.create(_field(1, "t") + _field(2, 5000) + _field(7, w.done())))) == packets.MAX_ENTRIES
    assert list(full.update(_field(1, 4) + _field(2, 1))) == []
    assert list(packets.messages(b"\xff" * 3)) == [(-1, None, "a packet ends inside a message")]
