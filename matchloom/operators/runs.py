"""Ordered runs of events within a partition: edges, streaks, bursts, rounds, state machines.

Each operator is a few window functions over one partitioning and order, so
several of them on one key share one shuffle and sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def rising(df: DataFrame, keys: Sequence[str], order: Sequence[str], when: Column, out: str = "edge") -> DataFrame:
    """True where a condition turns true; a null condition is false."""
    now = F.coalesce(when, F.lit(False))
    return df.withColumn("_now", now).withColumn(out, F.col("_now") & ~F.coalesce(F.lag("_now").over(_w(keys, order)), F.lit(False))).drop("_now")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, gap: int, broken: Column | None = None, out: str = "island") -> DataFrame:
    """Number of the run that a row belongs to: a run goes on while the gap is at most ``gap`` and nothing breaks it."""
    w = _w(keys, order)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True))
    if broken is not None:
        new = new | F.coalesce(broken, F.lit(False))
    return df.withColumn("_new", new.cast("int")).withColumn(out, F.sum("_new").over(w)).drop("_new")


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, gap: int, least: int, rounds: str | None = None, out: str = "streaks") -> DataFrame:
    """Runs of at least ``least`` events with gaps of at most ``gap``, by key.

    With ``rounds``, a run ends at a change of round, and the run that the last
    round ends in has not been closed by anything, so it does not count.
    """
    own = [*keys, rounds] if rounds else list(keys)
    runs = islands(df, own, order, at, gap).groupBy(*own, "island").agg(F.count("*").alias("n"))
    if rounds:
        w = Window.partitionBy(*keys).orderBy(F.desc(rounds), F.desc("island"))
        runs = runs.withColumn("_open", F.row_number().over(w) == 1).where("not _open")
    return runs.groupBy(*keys).agg(F.count_if(F.col("n") >= least).alias(out))


def bursts(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, gap: int, least: int, out: str = "pulse") -> DataFrame:
    """True where the ``least``-th event of a rolling window lands; again only after the window broke."""
    n = max(2, least)
    w = _w(keys, order)
    inside = F.coalesce(F.col(at) - F.lag(at, n - 1).over(w) <= gap, F.lit(False))
    return rising(df.withColumn("_in", inside), keys, order, F.col("_in"), out).drop("_in")


def numbered(df: DataFrame, keys: Sequence[str], order: str, starts: Column, out: str, block: int = 1 << 16) -> DataFrame:
    """How many ``starts`` a key has had by each row, in the order of a whole number.

    Counted by block of ``block`` numbers first, then inside each, so one key with all rows is many tasks; what is
    summed up in one place is a row for each block.
    """
    df = df.withColumns({"_block": F.floor(F.col(order) / block), "_start": F.coalesce(starts, F.lit(False))})
    each = df.groupBy(*keys, "_block").agg(F.count_if("_start").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.count_if("_start").over(Window.partitionBy(*keys, "_block").orderBy(order))
    return df.withColumn("_inside", inside).join(each, [*keys, "_block"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_block", "_start", "_inside", "_before")


def rounds(df: DataFrame, match: Sequence[str], order: Sequence[str], starts: Column, restarts: Column | None = None, out: str = "round_number", block: int | None = None) -> DataFrame:
    """Rounds started so far; a restart begins at 0 again.  With ``block``, one match that holds most rows is many tasks,
    and ``order`` is one whole number (see ``numbered``)."""
    if block is not None:
        starts = F.coalesce(starts, F.lit(False))
        df = numbered(df, match, order[0], F.lit(False) if restarts is None else restarts, "segment", block)
        df = numbered(df, match, order[0], starts, "_all", block).withColumn("_earlier", F.col("_all") - starts.cast("long"))
        # rounds that earlier segments have started: what the first row of the segment found
        first = df.groupBy(*match, "segment").agg(F.min("_earlier").alias("_first"))
        return df.join(first, [*match, "segment"]).withColumn(out, F.col("_all") - F.col("_first")).drop("_all", "_earlier", "_first")
    w = _w(match, order)
    if restarts is not None:
        df = df.withColumn("segment", F.count_if(F.coalesce(restarts, F.lit(False))).over(w))
        w = _w([*match, "segment"], order)
    return df.withColumn(out, F.count_if(F.coalesce(starts, F.lit(False))).over(w))


def state(df: DataFrame, keys: Sequence[str], order: Sequence[str], transitions: Column, initial: Column | None = None, before: bool = False, out: str = "state") -> DataFrame:
    """Where a state machine is: the last non-null transition, after a row or ``before`` it."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    now = F.last(transitions, ignorenulls=True).over(w)
    return df.withColumn(out, now if initial is None else F.coalesce(now, initial))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_k", F.row_number().over(_w(keys, order))).where("_k = 1").drop("_k")


def changed(df: DataFrame, keys: Sequence[str], order: Sequence[str], *values: Column) -> DataFrame:
    """Rows whose values differ from the row before; the first row of a key counts as changed."""
    w = _w(keys, order)
    now = F.struct(*[v.alias(f"c{k}") for k, v in enumerate(values)])
    return df.withColumn("_v", now).withColumn("_p", F.lag("_v").over(w)).where(~F.col("_v").eqNullSafe(F.col("_p"))).drop("_v", "_p")


def since_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, none: int = 1_000_000, out: str = "since") -> DataFrame:
    """Distance to the row before; ``none`` for the first row and for steps back."""
    step = F.col(at) - F.lag(at).over(_w(keys, order))
    return df.withColumn(out, F.when(step >= 0, step).otherwise(F.lit(none)))


def turn(df: DataFrame, keys: Sequence[str], order: Sequence[str], pitch: str, yaw: str, out: str = "turn_degrees") -> DataFrame:
    """Angle between a row's view direction and that of the row before; 0 for the first row."""
    w = _w(keys, order)
    direction = lambda p, y: (F.cos(F.radians(p)) * F.cos(F.radians(y)), F.cos(F.radians(p)) * F.sin(F.radians(y)), -F.sin(F.radians(p)))
    a, b = direction(F.col(pitch), F.col(yaw)), direction(F.lag(pitch).over(w), F.lag(yaw).over(w))
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    return df.withColumn(out, F.coalesce(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))), F.lit(0.0)))


def sampled(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The last row of each key, as aggregates: no sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_s")).select(*keys, "_s.*")
