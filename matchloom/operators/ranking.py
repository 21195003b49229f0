"""Order, top lists, supersession and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_with_rest(df: DataFrame, by: str, n: int, rest: str = "other") -> DataFrame:
    """The ``n`` most frequent values of ``by`` with their counts, and one row for all others."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    # the first n by a heap in each task; they are n rows, so they may be sent along
    top = counts.orderBy(F.desc("n"), by).limit(n).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), by)))
    sent = F.broadcast(top.select(F.col(by).alias("_top")))
    others = counts.join(sent, F.col(by).eqNullSafe(F.col("_top")), "left_anti").agg(F.sum("n").alias("n")).where("n is not null")
    return top.select(by, "place", "n").unionByName(others.select(F.lit(rest).alias(by), F.lit(n + 1).alias("place"), "n"))


def supersede(df: DataFrame, keys: Sequence[str], group: str, score: str) -> DataFrame:
    """Rows with their group's highest score, ties included; rows without a group stay."""
    best = F.max(score).over(Window.partitionBy(*keys, group))
    return df.withColumn("_best", best).where(F.col(group).isNull() | (F.col(score) >= F.col("_best"))).drop("_best")


def clip_window(at: Column, first: Column, round_start: Column, end: Column, lead: float, tail: float, rate: float) -> tuple[Column, Column]:
    """Start and end tick of a clip around a moment, inside its round and match, at least one tick long."""
    before, after = F.bround(F.lit(lead * rate)).cast("long"), F.bround(F.lit(tail * rate)).cast("long")
    start = F.greatest(F.lit(0), round_start, F.least(at - before, first))
    stop = F.least(end, at + after)
    return start, F.greatest(stop, start + 1)


def coalesce_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, title: str, order: Sequence[str]) -> DataFrame:
    """Overlapping or touching intervals of a key as one, with their titles in order."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce(F.col(start) > reached, F.lit(True)).cast("int")).withColumn("_g", F.sum("_new").over(w))
    titles = F.transform(F.array_sort(F.collect_list(F.struct(start, *order, F.col(title).alias("_t")))), lambda x: x["_t"])
    return marked.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), titles.alias("titles")).drop("_g")


def suggestions(names: DataFrame, name: str, wrong: str, most: int = 3, limit: int = 3) -> DataFrame:
    """Known names within a few edits of a wrong one, nearest first."""
    d = F.levenshtein(F.lower(F.col(name)), F.lit(wrong.lower()))
    return names.select(name, d.alias("distance")).distinct().where(F.col("distance") <= most).orderBy("distance", name).limit(limit)
