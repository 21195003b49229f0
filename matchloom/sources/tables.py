"""Tables of a data folder, and the event table as an ordered event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000
HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as seq, tick (microseconds), day (the round), actor, event, value, k, side (2 or 3).

    Times have no zone, so ticks are counted from the epoch without one.
    """
    tick = F.expr("unix_micros(to_utc_timestamp(cast(ts as timestamp), 'UTC'))")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        tick.alias("tick"),
        F.to_date("ts").alias("day"),
        F.col("user_id").alias("actor"),
        F.col("event_type").alias("event"),
        F.col("value").cast("decimal(18,2)").alias("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("user_id") % 2 + 2).alias("side"),
    )


#: The same as SQL, for queries to be held against.
LOG_SQL = """log as (select event_id as seq, epoch_us(ts) as tick, cast(ts as date) as day, user_id as actor, event_type as event,
    cast(value as decimal(18,2)) as value, cast(props->>'$.k' as int) as k, user_id % 2 + 2 as side from events)"""
