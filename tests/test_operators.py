"""Operators against plain folds, the language, sources, streams and geometry."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import scalar
from matchloom.lang import expr
from matchloom.lang.diagnostics import RuleError
from matchloom.operators import correlate, entity, geometry, ranking, runs
from matchloom.rules import model
from matchloom.sources import formats
from matchloom.streaming import twins


@pytest.fixture(scope="module")
def events():
    rng = random.Random(3)
    out, tick = [], 0
    for seq in range(300):
        tick += rng.choice([0, 1, 5, 20, 40])
        out.append(("m", rng.randrange(4), seq // 60, seq, tick, rng.random() < 0.5, rng.randrange(3)))
    return out


@pytest.fixture(scope="module")
def log(spark, events):
    return spark.createDataFrame(events, "match_id string, player long, round long, seq long, tick long, hit boolean, v long").repartition(3)


def _streaks(events, gap, least):
    done, state = {}, {}
    for _, p, r, _, t, *_ in events:
        last, round_, run = state.get(p, (None, None, 0))
        done.setdefault(p, 0)
        if run and r == round_ and t - last <= gap:
            run += 1
        else:
            done[p] += run >= least
            run = 1
        state[p] = (t, r, run)
    return done


def test_streaks(log, events):
    got = runs.streaks(log, ["player"], ["seq"], "tick", 50, 2, rounds="round")
    assert {r["player"]: r["streaks"] for r in got.collect()} == _streaks(events, 50, 2)


def _bursts(events, gap, n):
    out, state = set(), {}
    for _, p, _, s, t, *_ in events:
        ticks, inside = state.get(p, ([], False))
        ticks = [*ticks, t][-n:]
        now = len(ticks) == n and t - ticks[0] <= gap
        if now and not inside:
            out.add((p, s))
        state[p] = (ticks, now)
    return out


def test_bursts(log, events):
    got = runs.bursts(log, ["player"], ["seq"], "tick", 120, 3).where("pulse").collect()
    assert {(r["player"], r["seq"]) for r in got} == _bursts(events, 120, 3)


def test_as_of_is_strict(spark):
    e = spark.createDataFrame([(1, 5), (1, 10), (2, 5)], "k long, t long")
    s = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 8, None)], "k long, t long, v string")
    assert {(r["k"], r["t"]): r["v"] for r in correlate.as_of(e, s, ["k"], "t", ["v"]).collect()} == {(1, 5): None, (1, 10): "b", (2, 5): None}
    assert {(r["k"], r["t"]): r["v"] for r in correlate.as_of(e, s, ["k"], "t", ["v"], strict=False).collect()}[1, 5] == "a"


def test_within_is_inclusive(spark):
    a = spark.createDataFrame([(1, t) for t in (0, 256, 257, 600)], "k long, t long")
    b = spark.createDataFrame([(1, 0), (1, 344)], "k long, t long")
    got = {(r["t"], r["r_t"]) for r in correlate.within(a, b, ["k"], "t", 256).collect()}
    assert got == {(0, 0), (256, 0), (600, 344)}


def test_intervals_touch(spark):
    rows = [("a", 1, 0, 10, "x"), ("a", 2, 10, 12, "y"), ("a", 3, 13, 14, "z"), ("a", 4, 1, 2, "w")]
    got = ranking.coalesce_intervals(spark.createDataFrame(rows, "k string, n long, s long, e long, t string"), ["k"], "s", "e", "t", ["n"]).collect()
    assert sorted((r["s"], r["e"], r["titles"]) for r in got) == [(0, 12, ["x", "w", "y"]), (13, 14, ["z"])]


def test_entity(spark):
    rows = [(1, 1, None), (1, 2, None), (1, 3, 5), (2, 1, 7), (2, 2, 7), (2, 3, None)]
    df = spark.createDataFrame(rows, "k long, n long, v long")
    assert sorted((r["k"], r["n"]) for r in entity.cdc(df, ["k"], ["n"], "v").collect()) == [(1, 1), (1, 3), (2, 1), (2, 3)]
    h = spark.createDataFrame([(0xFFFFFF,), ((5 << 14) | 77,)], "h int").select(entity.handle_index(F.col("h")).alias("i"), entity.handle_serial(F.col("h")).alias("s"))
    assert [tuple(r) for r in h.collect()] == [(None, None), (77, 5)]


@pytest.mark.parametrize(
    ("text", "canonical"),
    [
        ("a + b * 2", "(a + (b * 2))"),
        ("not a and b or c", "(((not a) and b) or c)"),
        ("!a && b || c", "(((not a) and b) or c)"),
        ("-x.y[2] < 10s", "((- x.y[2]) < 640)"),
        ("w in [1, 500ms]", "(w in [1, 32])"),
        ('contains(s, "q\\"")', 'contains(s, "q\\"")'),
    ],
)
def test_parse(text, canonical):
    assert expr.render(expr.parse(text)) == canonical
    assert expr.render(expr.parse(canonical)) == canonical
    assert expr.render(expr.joined(expr.clauses(expr.parse(canonical)))) == canonical


@pytest.mark.parametrize(("text", "code"), [("a < b < c", "E_CHAIN"), ("a +", "E_SYNTAX"), ("f(1)", "E_NAME"), ("min(1)", "E_ARGS"), ('"x', "E_STRING"), ("a $ b", "E_CHAR")])
def test_syntax_errors(text, code):
    with pytest.raises(RuleError) as e:
        expr.parse(text)
    assert e.value.found[0].code == code


def test_types():
    types = {"n": "int", "x": "float", "s": "string", "b": "bool", "t": "instant"}.get
    kind = lambda text: expr.check(expr.parse(text), types)
    assert [kind(t) for t in ("n + n", "n / x", "t - t", "n > 1 and b", "floor(x)", "s in ['a']")] == ["int", "float", "duration", "bool", "float", "bool"]
    for bad in ("s + n", "not n", "s and b", "s > n", "zz"):
        with pytest.raises(RuleError):
            kind(bad)


def test_columns(spark):
    df = spark.createDataFrame([(7, 0, 2.0, "weapon_ak", None), (-7, 2, None, "knife_t", True)], "n long, z long, x double, s string, b boolean")
    types = {"n": "int", "z": "int", "x": "float", "s": "string", "b": "bool"}.get
    of = lambda text: expr.column(expr.parse(text), F.col, types)
    got = df.select(*[of(t).alias(f"c{k}") for k, t in enumerate(["n / z", "n % 3", "b and true", "not b", "x == null", "min(n, 3)", "startswith(s, 'weapon')", "x > 1", "n / 2.0"])]).collect()
    assert tuple(got[0]) == (0, 1, False, True, False, 3.0, True, True, 3.5)
    assert tuple(got[1]) == (-3, -1, True, False, True, -7.0, False, False, -3.5)


def test_scalars(spark):
    df = spark.createDataFrame([("weapon_ak47", 5, 130), ("weapon_knife_t", 6, 59), ("nova", 0, 0)], "w string, m int, t long")
    got = df.select(scalar.fires_bullets(F.col("w")).alias("b"), scalar.buttons(F.col("m"), {"jump": 2, "fire": 1}).alias("n"), scalar.clock(F.col("t"), 1.0).alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, "fire", "2:10"), (False, "jump", "0:59"), (False, None, "0:00")]


def test_rulesets_are_checked():
    text = "ruleset: r\nstats:\n  a: { count: kill, sum: x }\n  b: { count: kill, keep: list }\n  c: { tally: a }\n  d: { bucket: kill, key: k, per: round }\n  e: { flag: true }\nexports: [zz]\nbad: 1\n"
    with pytest.raises(RuleError) as e:
        model.read(text)
    assert {d.code for d in e.value.found} >= {"R_KIND", "R_FIELD", "R_VALUE", "R_SCOPE", "R_REF"}
    many = model.expanded({"{a}_{b}": {"for_each": {"a": ["x", "y"], "b": [1, 2]}, "count": "kill", "where": "n == {b}"}})
    assert list(many) == ["x_1", "x_2", "y_1", "y_2"] and many["y_2"]["where"] == "n == 2"
    one, two = model.read("ruleset: one\nuse: [two]\n---\nruleset: two\n")
    assert [r.id for r in model.ordered([one, two])] == ["two", "one"]
    with pytest.raises(RuleError):
        model.ordered(model.read("ruleset: a\nuse: [b]\n---\nruleset: b\nuse: [a]\n"))


def _frame(command, tick, payload):
    out = b""
    for n in (command, tick, len(payload)):
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        out += bytes([n])
    return out + payload


def test_frames(spark, tmp_path):
    whole = _frame(7 | 0x40, 300, b"abc") + _frame(2, 301, b"")
    (tmp_path / "a.log").write_bytes(whole)
    (tmp_path / "b.log").write_bytes(whole + _frame(2, 302, b"xyz")[:-1])
    (tmp_path / "c.log").write_bytes(b"\x80")
    df = formats.read_frames(spark, str(tmp_path))
    rows = df.where("path like '%a.log'").orderBy("frame_no").collect()
    assert [(r["command"], r["tick"], r["compressed"], bytes(r["payload"])) for r in rows] == [(7, 300, True, b"abc"), (2, 301, False, b"")]
    assert {r["path"][-5]: r["health"] for r in formats.health(df).collect()} == {"a": "clean", "b": "degraded", "c": "damaged"}
    assert list(formats.fields(b"\x08\x96\x01\x12\x02hi\x1d")) == [(1, 0, 1, 3), (2, 2, 5, 7)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b,c', None)], "n long, s string, x double")
    formats.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text == 'n,s,x\n1,"a""b,c",\n'
    assert formats.json_rows(df).first()[0] == '{"n":1,"s":"a\\"b,c","x":null}'
    assert formats.json_document(df, "t") == '{"name": "t", "columns": ["n", "s", "x"], "rows": [[1, "a\\"b,c", null]]}'


def test_streams(spark, tmp_path, events, log):
    schema = log.schema
    for k in range(3):  # three batches, in order
        spark.createDataFrame([e for e in events if e[3] // 100 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def ran(make, mode, name):
        q = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        q = q.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return spark.table(name).collect()

    got = ran(lambda s: twins.bursts(s, 120, 3), "append", "pulses")
    assert {(r["player"], r["seq"]) for r in got} == _bursts(events, 120, 3)
    got = ran(lambda s: twins.streaks(s, 50, 2, forget=3_600_000), "update", "streaks")
    assert {p: max(r["streaks"] for r in got if r["player"] == p) for p in range(4)} == _streaks(events, 50, 2)


def test_sight(spark):
    rng = np.random.default_rng(2)
    wall = np.array([[[0, -50, -50], [0, 50, -50], [0, 0, 80]]], float)
    mesh = np.concatenate((wall, rng.uniform(200, 300, (60, 3, 3))))
    pairs = spark.createDataFrame([(-10.0, 0.0, 0.0, 10.0, 0.0, 0.0), (-10.0, 90.0, 0.0, 10.0, 90.0, 0.0), (-10.0, 0.0, 0.0, -1.0, 0.0, 0.0)], "sx double, sy double, sz double, ex double, ey double, ez double")
    assert [r["visible"] for r in geometry.sight(pairs, mesh).orderBy("sy", "ex").collect()] == [True, False, True]
    tree = geometry.Tree.build(mesh)
    a, b = rng.uniform(150, 350, (200, 3)), rng.uniform(150, 350, (200, 3))
    each = np.array([min(geometry._triangle(np.repeat(x[None], len(mesh), 0), np.repeat((y - x)[None], len(mesh), 0), mesh)) for x, y in zip(a, b, strict=True)])
    assert np.allclose(tree.hits(a, b, nearest=True), each) and (np.isinf(tree.hits(a, b)) == np.isinf(each)).all()


def test_views_and_smoke(spark):
    df = spark.range(1).select(
        geometry.in_view(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(359.0), F.lit(0.0)).alias("ahead"),
        geometry.in_view(F.lit(-1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("behind"),
        geometry.smoked(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(100.0).alias("y"), F.lit(0.0).alias("z"))), *[F.lit(float(v)) for v in (-500, 0, 0, 500, 0, 0)]).alias("through"),
        F.size(geometry.anchors(*[F.lit(0.0)] * 5)).alias("n"),
    )
    assert tuple(df.first()) == (True, False, True, 6)
    s = spark.createDataFrame([("p", t, t != 8) for t in (0, 4, 8, 30, 32, 100)] + [("q", 0, True)], "p string, t long, seen boolean")
    assert [tuple(r) for r in geometry.seen_time(s, ["p"], "t", "seen").collect()] == [("p", 20, 5)]
