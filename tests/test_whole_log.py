"""Queries of the event log take all of it: each against a plain fold over a small log with large user ids."""

import datetime
import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from matchloom.operators import geometry
from matchloom.plans import QUERIES, stream_queries

USERS = [0, 3, 7, 12, 29, 30, 39, 40, 41, 55, 80, 81, 1001, 1002]


@pytest.fixture(scope="module")
def events():
    """(seq, day, actor, event, value, k)"""
    rng = random.Random(8)
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(k) for k in range(3)]
    kinds = ["view", "click", "purchase", "error", "signup"]
    return [(s, days[s // 240], rng.choice(USERS), rng.choice(kinds), rng.randrange(10_000) / 100, rng.randrange(100)) for s in range(700)]


@pytest.fixture(scope="module")
def folder(events, tmp_path_factory):
    out = tmp_path_factory.mktemp("log")
    at = [datetime.datetime.combine(d, datetime.time()) + datetime.timedelta(seconds=s) for s, d, *_ in events]
    seq, _, actor, event, value, k = zip(*events, strict=True)
    rows = {"event_id": seq, "ts": pa.array(at, pa.timestamp("us")), "user_id": actor, "event_type": event, "value": value, "props": [json.dumps({"k": x}) for x in k]}
    pq.write_table(pa.table(rows), str(out / "events.parquet"))
    return str(out)


def _rows(spark, folder, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, folder).collect())


def test_visibility_pairs(spark, events, folder):
    at = defaultdict(int)
    for _, day, actor, _, _, k in events:
        at[day, actor] += k
    mesh = stream_queries._mesh()
    seen, meetings = Counter(), Counter()
    for (day, a), x in at.items():
        for (other, b), y in at.items():
            if day == other and a % 2 != b % 2:
                start, end = np.array([x % 1000, x * 7 % 1000, 64.0]), np.array([y % 1000, y * 7 % 1000, 46.0])
                way = end - start
                length = np.linalg.norm(way)
                step = way / (length or 1) * geometry.EPSILON
                start, end = start + step, end - step
                each = len(mesh)
                free = length <= 2 * geometry.EPSILON or np.isinf(geometry._triangle(np.repeat(start[None], each, 0), np.repeat((end - start)[None], each, 0), mesh)).all()
                seen[a, b] += int(free)
                meetings[a, b] += 1
    got = _rows(spark, folder, "visibility_pairs")
    assert got == sorted((a, b, seen[a, b], n) for (a, b), n in meetings.items())
    assert {a for a, *_ in got} == set(USERS) and 0 < sum(seen.values()) < sum(meetings.values())


@pytest.mark.parametrize("small", [False, True])
def test_times_seen(spark, monkeypatch, small):
    """Blocks, tiles and counts in bytes change nothing: against a fold; nulls, a third side, ids of any size, who is alone."""
    if small:
        monkeypatch.setattr(geometry, "PLAYERS", 7)
        monkeypatch.setattr(geometry, "TILE", 3)
        monkeypatch.setattr(geometry, "KEYS", 2)
    rng = random.Random(5)
    ids = [-5, -4, 3, 8, 2**40, 2**40 + 1, *range(100, 120)]
    rows = [(d, a, a % 2 + 2 if a > 0 else 1, *((float(x := rng.randrange(0, 900, 60)), x * 7.0 % 1000) if rng.random() < 0.9 else (None, None))) for d in range(7) for a in ids if rng.random() < 0.7]
    rows += [(99, 3, 3, 1.0, 7.0), (None, 3, 3, 1.0, 7.0)]
    tree = geometry.Tree.build(stream_queries._mesh())
    want = Counter(), Counter()
    for d, a, s, *at in rows:
        for e, b, t, *to in rows:
            if d == e and s != t and None not in (d, *at, *to):
                want[0][a, b] += int(geometry.visible(tree, np.array([[*at, 64.0]]), np.array([[*to, 46.0]]))[0])
                want[1][a, b] += 1
    df = spark.createDataFrame(rows, "day long, actor long, side int, x double, y double")
    got = geometry.times_seen(df, "day", "actor", "side", 64.0, 46.0, stream_queries._mesh()).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, want[0][a, b], n) for (a, b), n in want[1].items())


def test_visibility_pairs_moves_no_pairs(spark, folder):
    """Pairs of a day are never rows: what joins is blocks of players, of which this log has one."""
    plan = QUERIES["visibility_pairs"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    joins = plan.count("Join ")
    assert joins == 1 and "other_x" not in plan, plan


def test_pair_matrix(spark, events, folder):
    at = Counter()
    for _, day, actor, _, value, _ in events:
        at[day, actor] += round(value * 100)
    want = [(day, a, b, x >= y) for (day, a), x in at.items() for (other, b), y in at.items() if day == other and a % 2 != b % 2]
    assert _rows(spark, folder, "pair_matrix") == sorted(want)


def test_pairs_by_block(spark, tmp_path):
    """Blocks change neither pairs nor columns, whatever the ids; files of them are a fraction in size."""
    from pyspark.sql import functions as F

    from matchloom.operators import correlate

    odd = spark.createDataFrame([(1, -3, 1, 2.0), (1, 4, 2, None), (1, 900, 2, 2.0), (1, 7, 3, float("nan")), (2, 7, 3, 1.0), (None, 4, 2, 1.0), (1, None, None, 1.0)], "day int, actor long, side long, v double")
    met = lambda rows, *block: correlate.pairs(rows, ["day"], "actor", "side", ["v"], *block)
    assert met(odd).columns == met(odd, F.floor(F.col("actor") / 128)).columns
    assert sorted(map(str, met(odd).collect())) == sorted(map(str, met(odd, F.floor(F.col("actor") / 128)).collect()))
    many = spark.range(1600).select(F.explode(F.expr("sequence(1, 4)")).alias("day"), F.col("id").alias("actor"), (F.col("id") % 2).alias("side"), (F.xxhash64("id") % 1000).cast("double").alias("v")).where("xxhash64(day, actor) % 9 <> 0")
    size = {}
    for name, rows in (("plain", met(many)), ("block", met(many, F.floor(F.col("actor") / 128)))):
        rows.select("day", "actor", "other_actor", (F.col("v") >= F.col("other_v")).alias("ahead")).write.parquet(str(tmp_path / name))
        size[name] = sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet"))
    assert size["block"] * 3 < size["plain"], size


def test_pair_matrix_is_small_on_disk(spark, tmp_path):
    """Fewer than half a byte for a pair: what a day's pairs take on disk bounds the job."""
    kinds = {"event_id": pa.int64(), "user_id": pa.int64(), "value": pa.float64()}
    n = 4000
    rng = random.Random(3)
    rows = {"event_id": range(n), "user_id": [rng.randrange(900) for _ in range(n)], "value": [rng.randrange(10_000) / 100 for _ in range(n)]}
    at = pa.array([datetime.datetime(2024, 1, 1 + s * 2 // n) for s in range(n)], pa.timestamp("us"))
    pq.write_table(pa.table({**{k: pa.array(v, kinds[k]) for k, v in rows.items()}, "ts": at, "event_type": ["view"] * n, "props": ['{"k": 1}'] * n}), str(tmp_path / "events.parquet"))
    QUERIES["pair_matrix"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    pairs = spark.read.parquet(str(tmp_path / "out")).count()
    assert pairs > 500_000 and size < pairs / 2, (size, pairs)


def test_pairs_by_size(spark):
    """Blocks of a given size change neither pairs nor columns; a key with many rows is the work of many tasks, and none has half of it."""
    from pyspark.sql import functions as F

    from matchloom.operators import correlate

    odd = [(1, -3, 1, 2.0, "a"), (1, 4, 2, None, "b"), (1, 900, 2, 2.0, None), (1, 900, 2, 2.0, None), (1, 900, 1, 7.0, "c"), (1, 7, 3, float("nan"), "d"), (2, 7, 3, 1.0, "e"), (None, 4, 2, 1.0, "f"), (1, None, None, 1.0, "g"), (1, None, 2, 1.0, "h")]
    odd = spark.createDataFrame(odd, "day int, actor long, side long, v double, more string")
    for columns in ([], ["v"], ["v", "more"]):
        want = correlate.pairs(odd, ["day"], "actor", "side", columns)
        assert want.count() == 18
        for block in (1, 2, 64):
            got = correlate.pairs(odd, ["day"], "actor", "side", columns, block)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    many = spark.range(3000).select((F.col("id") < 0).cast("int").alias("day"), F.col("id").alias("actor"), (F.col("id") % 2).alias("side"), (F.xxhash64("id") % 1000).cast("double").alias("v"))
    by_task = [r["count"] for r in correlate.pairs(many, ["day"], "actor", "side", ["v"], 64).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by_task) == 2 * 1500 * 1500 and max(by_task) * 2 < sum(by_task), by_task


def test_pair_matrix_of_one_day(spark, tmp_path):
    """Pairs of one day come from several tasks, and equal a fold."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    users, values = [rng.randrange(-50, 700) for _ in range(1500)], [rng.randrange(900) / 4 for _ in range(1500)]
    at = pa.array([datetime.datetime(2024, 1, 1)] * 1500, pa.timestamp("us"))
    pq.write_table(pa.table({"event_id": range(1500), "user_id": users, "value": values, "ts": at, "event_type": ["view"] * 1500, "props": ['{"k": 1}'] * 1500}), str(tmp_path / "events.parquet"))
    total = Counter()
    for a, v in zip(users, values, strict=True):
        total[a] += v
    side = {a: int(math.fmod(a, 2)) for a in total}
    want = [(datetime.date(2024, 1, 1), a, b, total[a] >= total[b]) for a in total for b in total if side[a] != side[b]]
    assert _rows(spark, str(tmp_path), "pair_matrix") == sorted(want)
    assert QUERIES["pair_matrix"](spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 1


def test_player_round_spine(spark, events, folder):
    n, total = Counter(), Counter()
    for _, day, actor, _, value, _ in events:
        n[actor, day] += 1
        total[actor, day] += round(value * 100)
    want = [(a, d, n[a, d], total[a, d] / 100) for a in USERS for d in {e[1] for e in events}]
    assert _rows(spark, folder, "player_round_spine") == sorted(want)


def test_metrics_outer_join(spark, events, folder):
    n = Counter((actor, event) for _, _, actor, event, _, _ in events)
    want = [(a, n[a, "click"] or None, n[a, "error"] or None) for a in USERS if n[a, "click"] or n[a, "error"]]
    assert _rows(spark, folder, "metrics_outer_join") == sorted(want)


def test_round_numbering(spark, events, folder):
    segment, number, rounds, rows = Counter(), Counter(), Counter(), Counter()
    for _, _, actor, event, _, _ in events:
        side = actor % 2 + 2
        if event == "signup":
            segment[side] += 1
            number[side] = 0
        number[side] += event == "error"
        rounds[side, segment[side]] = number[side]
        rows[side, segment[side]] += 1
    assert _rows(spark, folder, "round_numbering") == sorted((*x, rounds[x], n) for x, n in rows.items())


def test_snapshot_diff(spark, events, folder):
    middle, end = ({actor: k for s, _, actor, _, _, k in events if s <= upto} for upto in (events[-1][0] // 2, events[-1][0]))
    want = [(a, middle.get(a), k) for a, k in end.items() if middle.get(a) != k]
    assert _rows(spark, folder, "snapshot_diff") == sorted(want)


def test_numbered_by_block(spark, events):
    """Small blocks and whole windows number alike, restarts included."""
    from pyspark.sql import functions as F

    from matchloom.operators import runs

    df = spark.createDataFrame([(s, a % 2, e) for s, _, a, e, _, _ in events], "seq long, side int, event string")
    starts, restarts = F.col("event") == "error", F.col("event") == "signup"
    for again in (restarts, None):
        columns = ["side", "seq", "round_number", *(["segment"] if again is not None else [])]
        whole = runs.rounds(df, ["side"], ["seq"], starts, again).select(*columns)
        parts = runs.rounds(df, ["side"], ["seq"], starts, again, block=16).select(*columns)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_top_with_rest(spark):
    from matchloom.operators import ranking

    df = spark.createDataFrame([(x,) for x in "aaabbbccd"] + [(None,)] * 5, "k string")
    got = lambda n: sorted((r.place, r.k, r.n) for r in ranking.top_with_rest(df, "k", n).collect())
    assert got(2) == [(1, None, 5), (2, "a", 3), (3, "other", 6)] and got(9) == [(1, None, 5), (2, "a", 3), (3, "b", 3), (4, "c", 2), (5, "d", 1)]
