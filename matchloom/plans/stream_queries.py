"""Streaming operators run over the ``events`` table as a stream that ends, and lines of sight."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import geometry
from matchloom.plans.registry import query
from matchloom.sources.tables import HOUR, LOG_SQL, event_log, table
from matchloom.streaming import twins

L = f"with {LOG_SQL} "


def _folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; on one machine a temporary one where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="matchloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What an append-mode stream has put out once its source is read to the end."""
    out = _folder(spark)
    q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return raw.select(
        F.lit("all").alias("match_id"),
        F.col("user_id").alias("player"),
        F.unix_date(F.to_date("ts")).cast("long").alias("round"),
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("tick"),
        (F.col("value") > 50).alias("high"),
    )


@query(L + f""", w as (select actor, seq, coalesce(tick - lag(tick, 2) over (partition by actor order by seq) <= {12 * HOUR}, false) as inside from log)
    select actor as player, seq from (select *, lag(inside) over (partition by actor order by seq) as before from w) where inside and not coalesce(before, false)""")
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, twins.bursts(_stream(spark, sf_dir), 12 * HOUR, 3)).select("player", "seq")


@query(L + """, w as (select actor, day, seq, value > 50 as high, coalesce(lag(value > 50) over (partition by actor, day order by seq), false) as before from log)
    select actor as player, seq from w where high and not before""")
def stream_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, twins.rising(_stream(spark, sf_dir), "high")).select("player", "seq")


def _mesh() -> np.ndarray:
    """Walls of a grid of rooms, with gaps."""
    walls = []
    for k in range(1, 10):
        for j in range(10):
            if (k * 7 + j * 3) % 4:
                x, y = k * 100.0, j * 100.0
                walls += [[[x, y, 0], [x, y + 100, 0], [x, y, 200]], [[x, y + 100, 0], [x, y + 100, 200], [x, y, 200]]]
    return np.array(walls)


@query()
def visibility_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For how many moments a day each user could see each user of the other side, in a grid of rooms that events place them in."""
    # y follows from x, so there are no more than 1999 places
    at = event_log(spark, sf_dir).groupBy(F.unix_date("day").cast("long").alias("day"), "actor", "side").agg(
        (F.sum("k") % 1000).cast("double").alias("x"), (F.sum(F.col("k") * 7) % 1000).cast("double").alias("y")
    )
    return geometry.times_seen(at, "day", "actor", "side", 64.0, 46.0, _mesh())
