"""The stat kinds as aggregates: all stats of one scope share one groupBy.

A stat is an aggregate expression guarded by its own condition, so sixty stats of
one scope are one shuffle with map-side partial aggregation, not sixty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _if(when: Column | None, value: Column) -> Column:
    return value if when is None else F.when(when, value)


def count(when: Column | None = None) -> Column:
    """Matching events; 0 if none."""
    return F.count(_if(when, F.lit(1)))


def total(value: Column, when: Column | None = None) -> Column:
    """Sum over matching events; 0 if none."""
    return F.coalesce(F.sum(_if(when, value)), F.lit(0).cast("long"))


def first(value: Column, order: Column, when: Column | None = None) -> Column:
    """Value of the first matching event; null if none."""
    return F.min_by(_if(when, value), _if(when, order))


def last(value: Column, order: Column, when: Column | None = None) -> Column:
    return F.max_by(_if(when, value), _if(when, order))


def smallest(value: Column, when: Column | None = None) -> Column:
    return F.min(_if(when, value))


def largest(value: Column, when: Column | None = None) -> Column:
    return F.max(_if(when, value))


def listed(value: Column, order: Column, when: Column | None = None) -> Column:
    """Values of matching events in order; null if none.  Its size is that of the group's matches."""
    pairs = F.array_sort(F.collect_list(_if(when, F.struct(order.alias("o"), value.alias("v")))))
    return F.when(F.size(pairs) > 0, F.transform(pairs, lambda p: p["v"]))


def flag(when: Column) -> Column:
    """True if an event matched; false otherwise."""
    return F.coalesce(F.bool_or(when), F.lit(False))


def distinct(value: Column, when: Column | None = None) -> Column:
    return F.count_distinct(_if(when, value))


def over_spine(spine: DataFrame, stats: DataFrame, keys: Sequence[str], zero: Sequence[str] = ()) -> DataFrame:
    """A row for each key of the spine; ``zero`` columns of keys without events are 0."""
    out = spine.join(stats, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero}) if zero else out


def tally(per_round: DataFrame, keys: Sequence[str], value: str, thresholds: dict[str, int]) -> DataFrame:
    """Rounds by the highest threshold that their value meets; buckets exclude each other."""
    out = {}
    above = None
    for name, least in sorted(thresholds.items(), key=lambda t: -t[1]):
        out[name] = F.count_if((F.col(value) >= least) if above is None else (F.col(value) >= least) & (F.col(value) < above))
        above = least
    return per_round.groupBy(*keys).agg(*[out[n].alias(n) for n in thresholds])


REDUCERS = {
    "count": lambda v, o: F.count(F.lit(1)),
    "sum": lambda v, o: F.sum(v),
    "min": lambda v, o: F.min(v),
    "max": lambda v, o: F.max(v),
    "first": lambda v, o: F.min_by(v, o),
    "last": lambda v, o: F.max_by(v, o),
}


def bucket(events: DataFrame, keys: Sequence[str], by: Sequence[Column], reduce: str = "count", value: Column | None = None, order: str = "seq", out: str = "value", sep: str = "|") -> DataFrame:
    """A value for each key of each actor; several key parts are joined in order."""
    key = F.concat_ws(sep, *[b.cast("string") for b in by]) if len(by) > 1 else by[0].cast("string")
    return events.groupBy(*keys, key.alias("key")).agg(REDUCERS[reduce](value, F.col(order)).alias(out))


def rate(numerator: DataFrame, denominator: DataFrame, keys: Sequence[str], out: str = "rate") -> DataFrame:
    """Bucket over bucket by key: keys of zero denominators go, missing numerators are 0."""
    num, den = numerator.withColumnRenamed("value", "_n"), denominator.withColumnRenamed("value", "_d")
    return (
        den.where("_d <> 0").join(num, list(keys), "left").withColumn(out, F.coalesce(F.col("_n"), F.lit(0)).cast("double") / F.col("_d")).drop("_n", "_d")
    )
