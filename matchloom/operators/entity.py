"""Event-sourced state: a table of deltas (key, path, value, order) and what can be read from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(deltas: DataFrame, keys: Sequence[str], order: str, value: str, upto: Column | None = None) -> DataFrame:
    """The state after all deltas, or those up to a place: an aggregate, without a sort."""
    rows = deltas if upto is None else deltas.where(F.col(order) <= upto)
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def difference(deltas: DataFrame, keys: Sequence[str], order: str, value: str, before: int | Column, after: int | Column) -> DataFrame:
    """Keys whose value differs between two places, with both values: one pass over the deltas."""
    at = lambda n: F.max_by(F.when(F.col(order) <= n, F.col(value)), F.when(F.col(order) <= n, F.col(order)))
    both = deltas.where(F.col(order) <= F.greatest(F.lit(before), F.lit(after))).groupBy(*keys).agg(at(before).alias("before"), at(after).alias("after"))
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def cdc(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows that change their key's value; the first row of a key is a change even if null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("_k", F.row_number().over(w))
        .withColumn("_p", F.lag(value).over(w))
        .where((F.col("_k") == 1) | ~F.col(value).eqNullSafe(F.col("_p")))
        .drop("_k", "_p")
    )


def transitions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``rising`` and ``falling`` rows of a boolean series."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.lag(value).over(w), F.lit(False))
    now = F.coalesce(F.col(value), F.lit(False))
    return rows.withColumn("edge", F.when(now & ~before, "rising").when(~now & before, "falling")).where("edge is not null")


def first_sighting(rows: DataFrame, keys: Sequence[str], order: Sequence[str], valid: Column) -> DataFrame:
    """The first row of each key if it is valid; an invalid first row uses its key up."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").where(valid)


def until_broken(rows: DataFrame, keys: Sequence[str], order: Sequence[str], broken: Column) -> DataFrame:
    """Rows before the first broken one of their key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_b", F.bool_or(F.coalesce(broken, F.lit(False))).over(w)).where("not _b").drop("_b")


def handle_index(handle: Column) -> Column:
    """Entity index of a packed handle: its low 14 bits; null if the handle is all ones."""
    return F.when(handle != 0xFFFFFF, handle.bitwiseAND(0x3FFF))


def handle_serial(handle: Column) -> Column:
    return F.when(handle != 0xFFFFFF, F.shiftrightunsigned(handle, 14))


def world(cell: Column, offset: Column) -> Column:
    """World coordinate of a cell and an offset in it."""
    return (cell - 32) * 512 + offset


def wide(rows: DataFrame, keys: Sequence[str], path: str, value: str, paths: Sequence[str]) -> DataFrame:
    """One row for each key with a column for each of the given paths."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col(path) == p, F.col(value))).alias(p) for p in paths])
