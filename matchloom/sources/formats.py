"""Readers and sinks: event logs as JSON lines or Parquet, binary frame logs, and result tables.

A frame log is a file of frames: three varints (command, tick, size), then that
many bytes.  Bit 0x40 of the command says that the payload is compressed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of what a reader takes from an untrusted log.
MAX_BLOB, MAX_WARNINGS, COMPRESSED = 16 << 20, 256, 0x40
FRAMES = "path string, frame_no long, command int, tick long, compressed boolean, payload binary, warning string"


def varint(raw: bytes, at: int) -> tuple[int, int]:
    """Value and end of a little-endian base-128 number; raises IndexError if the bytes end, ValueError if it is too long."""
    out = shift = 0
    while True:
        b = raw[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out & 0xFFFFFFFF, at
        shift += 7
        if shift > 28:
            raise ValueError("a number of more than five bytes")


def frames(raw: bytes, start: int = 0) -> Iterator[tuple[int, int, int, bool, bytes | None, str | None]]:
    """(frame, command, tick, compressed, payload, warning); a broken log ends with a warning, it does not raise."""
    at, n = start, 0
    while at < len(raw):
        try:
            command, at = varint(raw, at)
            tick, at = varint(raw, at)
            size, at = varint(raw, at)
        except IndexError:
            yield n, -1, -1, False, None, "the log ends inside a frame header"
            return
        except ValueError as e:
            yield n, -1, -1, False, None, str(e)
            return
        if size > MAX_BLOB:
            yield n, command & ~COMPRESSED, tick, False, None, "a frame is larger than the limit"
            return
        payload = raw[at : at + size]
        at += size
        warning = "the log ends inside a frame" if len(payload) < size else None
        yield n, command & ~COMPRESSED, tick, bool(command & COMPRESSED), payload, warning
        n += 1


def fields(raw: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(field, wire type, start, end) of a serialized message, to where it can be read."""
    at = 0
    while at < len(raw):
        try:
            key, at = varint(raw, at)
            start, kind = at, key & 7
            if kind == 0:
                # up to ten bytes: negative numbers are written as large ones
                at = next(k for k in range(at, at + 10) if raw[k] < 128) + 1
            elif kind == 1:
                at += 8
            elif kind == 5:
                at += 4
            elif kind == 2:
                size, start = varint(raw, at)
                at = start + size
            else:
                return
        except (IndexError, ValueError, StopIteration):
            return
        if at > len(raw):
            return
        yield key >> 3, kind, start, at


def read_frames(spark: SparkSession, path: str, header: int = 0) -> DataFrame:
    """Frames of all logs of a folder; files are read by Spark, so any store will do."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in FRAMES.split(", ")]
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                for n, command, tick, packed, payload, warning in frames(raw, header):
                    rows.append((name, n, command, tick, packed, payload, warning))
                    if len(rows) == 10_000:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

    return files.mapInArrow(run, FRAMES)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def health(frames_: DataFrame) -> DataFrame:
    """path, frames, warnings, health of each log: clean, degraded (its end is missing) or damaged (nothing could be read)."""
    found = frames_.groupBy("path").agg(F.count_if(F.col("payload").isNotNull()).alias("frames"), F.slice(F.array_sort(F.collect_set("warning")), 1, MAX_WARNINGS).alias("warnings"))
    return found.withColumn("health", F.when(F.size("warnings") == 0, "clean").when(F.col("frames") > 0, "degraded").otherwise("damaged"))


def read_events(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An event log as JSON lines; lines that cannot be read are kept in ``_corrupt_record``."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return (reader.schema(f"{schema}, _corrupt_record string") if schema else reader).json(path)


def sub_ticks(moves: DataFrame, array: str, buttons: dict[str, int]) -> DataFrame:
    """Moves inside a tick as rows in order of their time, each with the first button that its mask has."""
    from matchloom.functions.scalar import buttons as named

    rows = moves.select("*", F.posexplode(array).alias("move_no", "move")).drop(array)
    return rows.select("*", "move.*").drop("move").withColumn("button", named(F.col("mask"), buttons)).orderBy("when", "move_no")


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180: header, quotes doubled, empty for null."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """A JSON object for each row, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def json_document(df: DataFrame, name: str, most: int = 100_000) -> str:
    """A small table as one document of name, columns and rows; raises if it has more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write json_rows instead")
    return json.dumps({"name": name, "columns": df.columns, "rows": [list(r) for r in rows]}, default=str)
