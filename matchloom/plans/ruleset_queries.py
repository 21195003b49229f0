"""Rulesets over the ``events`` table, and the tables that come out of them."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.plans.registry import query
from matchloom.plans.ruleset import Planner, Report
from matchloom.rules.catalog import EVENTS
from matchloom.rules.model import read
from matchloom.sources.tables import LOG_SQL, event_log

L = f"with {LOG_SQL} "

RULES = """
ruleset: shop
title: What users do
exports: [conversion]
params: { least: { type: int, default: 2, min: 1, max: 9 } }
define:
  late_purchase: { on: purchase, match: { large: true } }
stats:
  clicks: { count: click, per: round }
  errors: { flag: true, on: error, per: round }
  last_k: { capture: event.k, on: click, per: round }
  busy: { flag: { when: "clicks > 1 or errors" }, per: round }
  total_clicks: { count: click }
  late: { count: late_purchase, where: "event.k in [60, 70, 80, 90] or event.k > 95" }
  k_sum: { sum: event.k, on: purchase }
  conversion: { compute: "k_sum / total_clicks", format: F2 }
  multi: { tally: clicks, thresholds: [ { min: 3, target: triples }, { min: 2, target: doubles } ] }
  clicks_by_k: { bucket: click, key: "event.k % 5" }
highlights:
  spree: { when: "clicks >= params.least", title: "{clicks} clicks" }
show:
  scoreboard:
    - { stat: total_clicks, label: Clicks, group: game }
    - { stat: spree.count, label: Sprees, group: game }
"""


EDGES = """
ruleset: edges
stats:
  open: { flag: true, on: purchase, off: error }
  opened: { count: open }
  alarm: { flag: true, on: error, off: { on: click, match: { large: true } }, per: round }
  alarms: { count: alarm, per: round }
  all_alarms: { count: alarm }
  alarm_rounds: { count: error, per: round }
  views: { count: view }
  seen: { count: view }
highlights:
  second: { when: "alarm_rounds == 2", title: "{alarm_rounds}" }
show:
  tables:
    moments: { per: event, columns: [ { stat: highlight }, { stat: tick } ] }
"""


@lru_cache(maxsize=2)
def _rules(text: str = RULES):
    return read(text)


def _report(spark: SparkSession, sf_dir: str, text: str = RULES) -> Report:
    log = event_log(spark, sf_dir)
    log = log.withColumns({"match_id": F.lit("all"), "round_number": F.dayofmonth("day").cast("long"), "value": F.col("value").cast("double")})
    players = log.groupBy("match_id", F.col("actor").alias("player")).agg(F.lit(1).alias("_")).drop("_")
    return next(iter(Planner(log, players, EVENTS).run(_rules(text)).values()))


GAME = L + """, r as (select actor, day, count(*) filter (event = 'click') as n from log group by actor, day),
    t as (select actor, count(*) filter (n >= 3) as triples, count(*) filter (n = 2) as doubles, count(*) filter (n >= 2) as sprees from r group by actor),
    g as (select actor, count(*) filter (event = 'click') as total_clicks, count(*) filter (event = 'purchase' and k >= 50 and (k in (60, 70, 80, 90) or k > 95)) as late,
        coalesce(sum(k) filter (event = 'purchase'), 0) as k_sum from log group by actor)"""


@query(GAME + " select actor as player, total_clicks, late, cast(k_sum as bigint) as k_sum, case when total_clicks = 0 then 0 else round(k_sum / total_clicks, 2) end as conversion, triples, doubles, sprees from g join t using (actor)")
def player_game_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    game = _report(spark, sf_dir).game
    return game.select("player", "total_clicks", "late", "k_sum", "conversion", "triples", "doubles", F.coalesce("`spree.count`", F.lit(0)).alias("sprees"))


@query(L + """, r as (select actor, day, count(*) filter (event = 'click') as clicks, coalesce(bool_or(event = 'error'), false) as errors, arg_max(k, seq) filter (event = 'click') as last_k from log group by actor, day)
    select a.actor as player, cast(day(d.day) as bigint) as round_number, coalesce(clicks, 0) as clicks, coalesce(errors, false) as errors, last_k, coalesce(clicks, 0) > 1 or coalesce(errors, false) as busy, coalesce(clicks, 0) >= 2 as spree
    from (select distinct actor from log) a cross join (select distinct day from log) d left join r on r.actor = a.actor and r.day = d.day""")
def player_round_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).rounds.select("player", "round_number", "clicks", "errors", "last_k", "busy", "spree")


@query(L + "select actor as player, cast(k % 5 as varchar) as key, count(*) as value from log where event = 'click' group by all")
def player_keyed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).keyed["clicks_by_k"].select("player", "key", "value")


@query(L + """, c as (select actor, day, seq, tick, row_number() over (partition by actor, day order by seq) as n from log where event = 'click')
    select 'spree' as chain, actor as player, cast(day(day) as bigint) as round_number, seq, tick, '2 clicks' as title from c where n = 2""")
def rule_chain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).moments.select(F.col("highlight").alias("chain"), "player", "round_number", "seq", "tick", "title")


@query(GAME + ' select actor as player, total_clicks as "Clicks", sprees as "Sprees" from g join t using (actor)')
def configured_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = _report(spark, sf_dir).tables["scoreboard_game"]
    return board.select("player", "Clicks", F.coalesce("Sprees", F.lit(0)).alias("Sprees"))


@query(L + """, o as (select actor, seq, event = 'purchase' as on_, lag(event = 'purchase') over (partition by actor order by seq) as before from log where event in ('purchase', 'error')),
    a as (select actor, day, seq, event = 'error' as on_, lag(event = 'error') over (partition by actor, day order by seq) as before from log where event = 'error' or event = 'click' and k >= 50),
    e as (select actor, count(*) filter (on_ and not coalesce(before, false)) as opened, arg_max(on_, seq) as open from o group by actor),
    n as (select actor, count(*) filter (on_ and not coalesce(before, false)) as all_alarms from a group by actor),
    v as (select actor, count(*) filter (event = 'view') as views from log group by actor)
    select v.actor as player, coalesce(open, false) as open, coalesce(opened, 0) as opened, coalesce(all_alarms, 0) as all_alarms, views, views as seen
    from v left join e on e.actor = v.actor left join n on n.actor = v.actor""")
def flag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that turn off, and how often they turn on again."""
    return _report(spark, sf_dir, EDGES).game.select("player", "open", "opened", "all_alarms", "views", "seen")


@query(L + """, a as (select actor, day, seq, event = 'error' as on_, lag(event = 'error') over (partition by actor, day order by seq) as before from log where event = 'error' or event = 'click' and k >= 50),
    n as (select actor, day, count(*) filter (on_ and not coalesce(before, false)) as alarms, arg_max(on_, seq) as alarm from a group by actor, day)
    select p.actor as player, cast(day(d.day) as bigint) as round_number, coalesce(alarms, 0) as alarms, coalesce(alarm, false) as alarm
    from (select distinct actor from log) p cross join (select distinct day from log) d left join n on n.actor = p.actor and n.day = d.day""")
def flag_edges_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, EDGES).rounds.select("player", "round_number", "alarms", "alarm")


@query(L + """, c as (select actor, day, seq, tick, row_number() over (partition by actor, day order by seq) as n from log where event = 'error')
    select 'second' as highlight, actor as player, cast(day(day) as bigint) as round_number, seq, tick from c where n = 2""")
def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configured table with a row for each moment."""
    return _report(spark, sf_dir, EDGES).tables["moments"].select("highlight", "player", "round_number", "seq", "tick")
