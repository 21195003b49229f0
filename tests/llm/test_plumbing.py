"""Hashes of words, places of repeated values, slots and folders."""

import random
import re
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest

from matchloom.llm import common, subword, windows, wordhash


@pytest.mark.parametrize("lower", [False, True])
def test_words(lower):
    rng = random.Random(5)
    texts = [b"", b" ", b"a", b" Ab  cd\n", b"x y " * 300_000, b"a" * 1_500_000 + b" B " + b"a" * 1_500_000, "É žluť \x0b\x0c ab\x1fc".encode()]
    texts += [bytes(rng.choice(b"abAB \t\n\xc3") for _ in range(rng.randrange(60))) for _ in range(300)]
    known: dict[bytes, int] = {}
    for raw in texts:
        hashes, start, end = wordhash.words(raw, lower)
        assert [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)] == raw.split()
        small = bytes(c + 32 if 65 <= c <= 90 else c for c in raw) if lower else raw
        for word, h in zip(small.split(), hashes.tolist(), strict=True):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_places_of_repeated_values():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 5), (1000, 50), (1000, 1 << 60), (200_000, 150_000)):
        x = rng.integers(0, m, n).astype(np.uint64)
        order = np.argsort(x, kind="stable")
        _, place, many = np.unique(x, return_inverse=True, return_counts=True)
        assert windows._again(x).tolist() == [k for k in order.tolist() if many[place[k]] > 1]


def test_slots_follow_the_input(spark, docs, tmp_path):
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) + 128
    assert common.slots(docs([(1, "a")])) == least
    spark.range(2_000_000).selectExpr("id", "sha2(cast(id as string), 256) as text").coalesce(2).write.option("compression", "none").parquet(str(tmp_path / "t"))
    df, size = spark.read.parquet(str(tmp_path / "t")), common.SLOT_BYTES
    try:
        common.SLOT_BYTES = 100_000
        assert common.slots(df) > least and common.slots(df.join(df.withColumnRenamed("text", "other"), "id")) <= 3 * common.slots(df)
    finally:
        common.SLOT_BYTES = size


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, base: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: base, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://x:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            common.shared_folder(session(master, None))
        assert common.shared_folder(session(master, "hdfs://x/c")).startswith("hdfs://x/c/matchloom/")
    for master in ("local", "local[4]", "local[*]"):
        assert "matchloom" in common.shared_folder(session(master, None))


def test_free_memory_of_the_driver_goes_back(spark):
    """What the JVM has freed outside its heap, but keeps, is given back whenever a table is written."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"Anonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) >> 10
    common.written(spark.range(3))  # what a first job loads
    block = bytes(64 << 10)
    made = [spark._jvm.java.util.zip.Deflater() for _ in range(800)]
    for d in made:
        d.setInput(block)
        d.deflate(bytearray(10))
    for d in made[:-1]:
        d.end()
    before = held()
    assert common.written(spark.range(3)).count() == 3
    assert held() < before - 60
    made[-1].end()


def test_the_sample_takes_eight_bytes_a_feature():
    c = subword.Config(pairs=True)
    text = " ".join(f"w{k % 700} again" for k in range(2000))
    at, count = subword._counted(text, c)
    assert at.nbytes + count.nbytes == 8 * len(at) and (np.diff(at) > 0).all() and 0 <= at.min() and at.max() < c.buckets
    assert count.sum() == sum(len(w) + 2 - n + 1 for w in text.split() for n in c.ngrams) + 4000 + 3999
    rows = [(f"{w} {k} some words", k % 2) for k, w in enumerate(["left", "right"] * 30)]
    one, two = subword.train(rows, [0, 1], c), subword.train(iter(rows), [0, 1], c)
    assert (one.table == two.table).all() and one.temperature == two.temperature
