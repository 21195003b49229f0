"""The event operators on the ``events`` table: a user is an actor, a UTC day a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import scalar
from matchloom.operators import correlate, entity, ranking, runs, stats
from matchloom.plans.registry import query
from matchloom.sources.tables import DAY, HOUR, LOG_SQL, event_log

L = f"with {LOG_SQL} "
C = F.col
ACTOR, ROUND, SEQ = ["actor"], ["actor", "day"], ["seq"]


def _is(event: str):
    return C("event") == event


@query(L + """select actor, count(*) filter (event = 'view') as views, count(*) filter (event = 'click') as clicks,
    count(*) filter (event = 'purchase' and k >= 50) as large_purchases, count(distinct k) as distinct_k from log group by actor""")
def count_by_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).groupBy("actor").agg(
        stats.count(_is("view")).alias("views"),
        stats.count(_is("click")).alias("clicks"),
        stats.count(_is("purchase") & (C("k") >= 50)).alias("large_purchases"),
        stats.distinct(C("k")).alias("distinct_k"),
    )


@query(L + """select actor, cast(coalesce(sum(value) filter (event = 'purchase'), 0) as double) as spent,
    cast(coalesce(sum(floor(value)) filter (event = 'error'), 0) as double) as lost from log group by actor""")
def sum_by_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).groupBy("actor").agg(
        stats.total(C("value"), _is("purchase")).cast("double").alias("spent"),
        stats.total(F.floor("value"), _is("error")).cast("double").alias("lost"),
    )


@query(L + """select actor, day, arg_min(k, seq) filter (event = 'click') as first_k, arg_max(k, seq) filter (event = 'click') as last_k,
    cast(min(value) filter (event = 'click') as double) as low, cast(max(value) filter (event = 'click') as double) as high from log group by actor, day""")
def capture_first_last_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).groupBy(*ROUND).agg(
        stats.first(C("k"), C("seq"), _is("click")).alias("first_k"),
        stats.last(C("k"), C("seq"), _is("click")).alias("last_k"),
        stats.smallest(C("value"), _is("click")).cast("double").alias("low"),
        stats.largest(C("value"), _is("click")).cast("double").alias("high"),
    )


@query(L + "select actor, day, string_agg(cast(k as varchar), ',' order by seq) filter (event = 'click') as ks, count(*) filter (event = 'click') as n from log group by actor, day")
def capture_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_log(spark, sf_dir).groupBy(*ROUND).agg(stats.listed(C("k"), C("seq"), _is("click")).alias("ks"), stats.count(_is("click")).alias("n"))
    return found.withColumn("ks", F.array_join("ks", ","))


@query(L + """select actor, clicks, purchases, case when purchases = 0 then 0 else clicks / purchases end as ratio,
    case when purchases = 0 then 0 else clicks // purchases end as whole, case when clicks + purchases > 20 then true else false end as busy
    from (select actor, count(*) filter (event = 'click') as clicks, count(*) filter (event = 'purchase') as purchases from log group by actor)""")
def compute_safe_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_log(spark, sf_dir).groupBy("actor").agg(stats.count(_is("click")).alias("clicks"), stats.count(_is("purchase")).alias("purchases"))
    return found.select(
        "*",
        scalar.divide(C("clicks"), C("purchases")).alias("ratio"),
        scalar.divide(C("clicks"), C("purchases"), whole=True).alias("whole"),
        scalar.truth(C("clicks") + C("purchases") > 20).alias("busy"),
    )


@query(L + """, ends as (select max(seq) as last_end from log where event = 'signup'),
    t as (select * from log, ends where seq <= last_end)
    select actor, count(*) as events_until_last_end, cast(sum(value) as double) as value_until_last_end from t group by actor""")
def compute_until_round_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula counts events up to the last round end only; here a sign-up ends a round."""
    log = event_log(spark, sf_dir)
    end = log.where(_is("signup")).agg(F.max("seq").alias("e")).scalar()
    return log.where(C("seq") <= end).groupBy("actor").agg(F.count("*").alias("events_until_last_end"), F.sum("value").cast("double").alias("value_until_last_end"))


@query(L + """select seq, actor, clicks_so_far, events_so_far, case when events_so_far = 0 then 0 else clicks_so_far / events_so_far end as share from (
    select seq, actor, count(*) filter (event = 'click') over w as clicks_so_far, count(*) over w as events_so_far from log window w as (partition by actor order by seq))""")
def compute_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("actor").orderBy("seq")
    running = event_log(spark, sf_dir).select("seq", "actor", F.count_if(_is("click")).over(w).alias("clicks_so_far"), F.count("*").over(w).alias("events_so_far"))
    return running.withColumn("share", scalar.divide(C("clicks_so_far"), C("events_so_far")))


@query(L + """, r as (select actor, day, count(*) as n from log group by actor, day)
    select actor, count(*) filter (n >= 5) as five, count(*) filter (n = 4) as four, count(*) filter (n = 3) as three, count(*) filter (n = 2) as two from r group by actor""")
def tally_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_round = event_log(spark, sf_dir).groupBy(*ROUND).agg(F.count("*").alias("n"))
    return stats.tally(per_round, ACTOR, "n", {"five": 5, "four": 4, "three": 3, "two": 2})


STREAK = L + """, g as (select actor, {r} seq, case when tick - lag(tick) over (partition by actor{rk} order by seq) <= {gap} then 0 else 1 end as new from log),
    i as (select actor, {r} sum(new) over (partition by actor{rk} order by seq) as island from g),
    n as (select actor, {r} island, count(*) as n from i group by actor, {r} island)"""


@query(STREAK.format(r="", rk="", gap=8 * HOUR) + " select actor, count(*) filter (n >= 3) as streaks from n group by actor")
def streak_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.streaks(event_log(spark, sf_dir), ACTOR, SEQ, "tick", 8 * HOUR, 3)


@query(STREAK.format(r="day,", rk=", day", gap=8 * HOUR) + """, o as (select *, row_number() over (partition by actor order by day desc, island desc) as k from n)
    select actor, count(*) filter (n >= 2) as streaks from o where k > 1 group by actor""")
def streak_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.streaks(event_log(spark, sf_dir), ACTOR, SEQ, "tick", 8 * HOUR, 2, rounds="day")


@query(L + f""", w as (select actor, seq, coalesce(tick - lag(tick, 2) over (partition by actor order by seq) <= {12 * HOUR}, false) as inside from log)
    select actor, seq from (select *, lag(inside) over (partition by actor order by seq) as before from w) where inside and not coalesce(before, false)""")
def burst_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.bursts(event_log(spark, sf_dir), ACTOR, SEQ, "tick", 12 * HOUR, 3).where("pulse").select("actor", "seq")


@query(L + """select actor, event as key, count(*) as n, cast(sum(value) as double) as total, cast(min(value) as double) as low, cast(max(value) as double) as high,
    arg_min(k, seq) as first_k, arg_max(k, seq) as last_k from log group by actor, event""")
def bucket_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    red = lambda kind, c: stats.REDUCERS[kind](C(c), C("seq"))
    return log.groupBy("actor", C("event").alias("key")).agg(
        red("count", "k").alias("n"),
        red("sum", "value").cast("double").alias("total"),
        red("min", "value").cast("double").alias("low"),
        red("max", "value").cast("double").alias("high"),
        red("first", "k").alias("first_k"),
        red("last", "k").alias("last_k"),
    )


@query(L + "select actor, event || '|' || cast(k % 3 as varchar) as key, cast(sum(value) as double) as value from log group by all")
def bucket_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.bucket(event_log(spark, sf_dir), ACTOR, [C("event"), C("k") % 3], "sum", C("value"))
    return found.withColumn("value", C("value").cast("double"))


@query(L + """, n as (select actor, cast(k % 10 as varchar) as key, count(*) as n from log where event = 'purchase' group by all),
    d as (select actor, cast(k % 10 as varchar) as key, count(*) as d from log where event = 'view' group by all)
    select actor, key, coalesce(n, 0) / d as rate from d left join n using (actor, key) where d <> 0""")
def rate_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    by = lambda e: stats.bucket(log.where(_is(e)), ACTOR, [C("k") % 10])
    return stats.rate(by("purchase"), by("view"), ["actor", "key"])


@query(L + """select actor, day, coalesce(bool_or(event = 'error'), false) as failed, coalesce(bool_or(event = 'error'), false) and count(*) filter (event = 'purchase') > 0 as failed_and_bought,
    arg_max(event = 'signup', seq) filter (event in ('signup', 'error')) as last_on from log group by actor, day""")
def flag_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag set by an event, one of sibling stats, and one that another event clears."""
    found = event_log(spark, sf_dir).groupBy(*ROUND).agg(
        stats.flag(_is("error")).alias("failed"),
        stats.count(_is("purchase")).alias("bought"),
        stats.last(_is("signup"), C("seq"), C("event").isin("signup", "error")).alias("last_on"),
    )
    return found.select(*ROUND, "failed", (C("failed") & (C("bought") > 0)).alias("failed_and_bought"), "last_on")


EDGE = L + """, c as (select actor, day, seq, tick, count(*) filter (event in ('click', 'purchase')) over (partition by actor, day order by seq) >= 2 as on_ from log),
    e as (select *, on_ and not coalesce(lag(on_) over (partition by actor, day order by seq), false) as edge from c)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(*ROUND).orderBy("seq")
    log = event_log(spark, sf_dir).withColumn("on_", F.count_if(C("event").isin("click", "purchase")).over(w) >= 2)
    return runs.rising(log, ROUND, SEQ, C("on_"))


@query(EDGE + " select actor, day, seq, tick from e where edge")
def highlight_rising_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).where("edge").select("actor", "day", "seq", "tick")


@query(EDGE + " select actor, count(*) filter (edge) as fired, min(tick) filter (edge) as first_tick from e group by actor")
def highlight_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a highlight fires, with the tick of the first time."""
    return _edges(spark, sf_dir).groupBy("actor").agg(F.count_if("edge").alias("fired"), F.min(F.when(C("edge"), C("tick"))).alias("first_tick"))


@query(L + "select day, actor, event, seq from log qualify row_number() over (partition by day order by seq) = 1")
def first_of_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a min_by is a partial aggregate; a window would sort whole days
    return event_log(spark, sf_dir).groupBy("day").agg(F.min_by(F.struct("actor", "event", "seq"), "seq").alias("f")).select("day", "f.*")


@query(L + """select actor, seq, event, day from (select *, lag(struct_pack(event := event, day := day)) over (partition by actor order by seq) as p from log)
    where p is null or p <> struct_pack(event := event, day := day)""")
def dedup_same_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.changed(event_log(spark, sf_dir), ACTOR, SEQ, C("event"), C("day")).select("actor", "seq", "event", "day")


@query(L + "select actor, seq, case when s >= 0 then s else 1000000 end as since from (select actor, seq, tick - lag(tick) over (partition by actor order by seq) as s from log)")
def lag_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.since_last(event_log(spark, sf_dir), ACTOR, SEQ, "tick").select("actor", "seq", "since")


@query(L + f""", g as (select actor, seq, k, case when tick - lag(tick) over w <= {DAY} and k >= lag(k) over w - 25 then 0 else 1 end as new from log where event = 'click' window w as (partition by actor order by seq)),
    i as (select *, sum(new) over (partition by actor order by seq) as island from g)
    select actor, seq, row_number() over (partition by actor, island order by seq) as shots,
        len(list_distinct(list(k) over (partition by actor, island order by seq))) as victims from i""")
def spray_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that a second condition breaks as well, with running counts of rows and distinct values."""
    log = event_log(spark, sf_dir).where(_is("click"))
    w = Window.partitionBy("actor").orderBy("seq")
    found = runs.islands(log, ACTOR, SEQ, "tick", DAY, broken=C("k") < F.lag("k").over(w) - 25)
    own = Window.partitionBy("actor", "island").orderBy("seq")
    return found.select("actor", "seq", F.row_number().over(own).cast("long").alias("shots"), F.size(F.collect_set("k").over(own)).cast("long").alias("victims"))


@query(L + """, n as (select *, count(*) filter (event = 'signup') over (partition by side order by seq) as segment from log),
    r as (select *, count(*) filter (event = 'error') over (partition by side, segment order by seq) as round_number from n)
    select side, segment, max(round_number) as rounds, count(*) as events from r group by side, segment""")
def round_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of each side by running count of a marker, anew after every restart."""
    found = runs.rounds(event_log(spark, sf_dir), ["side"], SEQ, _is("error"), _is("signup"), block=1 << 16)
    return found.groupBy("side", "segment").agg(F.max("round_number").alias("rounds"), F.count("*").alias("events"))


@query(L + """select actor, seq, coalesce(last_value(case event when 'signup' then 'open' when 'purchase' then 'paid' when 'error' then 'failed' end ignore nulls)
    over (partition by actor order by seq rows between unbounded preceding and 1 preceding), 'new') as state from log""")
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.when(_is("signup"), "open").when(_is("purchase"), "paid").when(_is("error"), "failed")
    return runs.state(event_log(spark, sf_dir), ACTOR, SEQ, now, F.lit("new"), before=True).select("actor", "seq", "state")


@query(L + "select actor, day, arg_max(event, seq) as event, arg_max(k, seq) as k, max(seq) as seq from log group by actor, day")
def round_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sampled(event_log(spark, sf_dir), ROUND, "seq", ["event", "k", "seq"])


@query(L + """select seq, actor, cast(last_value(case when event = 'view' then value end ignore nulls) over (partition by actor order by seq rows between unbounded preceding and 1 preceding) as double) as value
    from log qualify event = 'purchase'""")
def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    found = correlate.as_of(log.where(_is("purchase")).select("seq", "actor"), log.where(_is("view")).select("seq", "actor", "value"), ACTOR, "seq", ["value"])
    return found.select("seq", "actor", C("value").cast("double").alias("value"))


_DEATH_SQL = L + ", d as (select day, seq, tick, actor as killer, (actor + k) % 40 as victim, actor % 2 + 2 as killer_side, (actor + k) % 40 % 2 + 2 as victim_side from log where event = 'purchase')"


def _deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as kills: the buyer, and a victim that the event's number names."""
    victim = (C("actor") + C("k")) % 40
    return event_log(spark, sf_dir).where(_is("purchase")).select("day", "seq", "tick", C("actor").alias("killer"), victim.alias("victim"), C("side").alias("killer_side"), (victim % 2 + 2).alias("victim_side"))


@query(_DEATH_SQL + f""", p as (select a.day, a.seq, b.victim as avenged, row_number() over (partition by a.day, a.seq order by b.victim, b.seq) as k from d a join d b
    on a.day = b.day and a.victim = b.killer and a.killer_side = b.victim_side and a.killer <> b.victim and b.seq < a.seq and a.tick - b.tick between 0 and {6 * HOUR})
    select day, seq, avenged as traded from p where k = 1""")
def trade_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.trades(_deaths(spark, sf_dir), ["day"], "tick", 6 * HOUR, "side")


@query(_DEATH_SQL + f""", f as (select day, seq, tick, actor, k from log where event = 'error'),
    u as (select day, tick, seq, killer as actor, null::int as k, true as is_d from d union all select day, tick, seq, actor, k, false from f),
    w as (select *, last_value(case when not is_d then k end ignore nulls) over x as lk, last_value(case when not is_d then tick end ignore nulls) over x as lt from u window x as (partition by actor order by tick, is_d rows unbounded preceding))
    select seq, actor, case when tick - lt <= {DAY} then lk end as touch from w where is_d""")
def last_touch_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actor's last error before a kill, if it is at most a day old."""
    kills = _deaths(spark, sf_dir).select("seq", "tick", C("killer").alias("actor"))
    errors = event_log(spark, sf_dir).where(_is("error")).select("actor", "tick", "k")
    return correlate.last_touch(kills, errors, ACTOR, "tick", DAY, "k").select("seq", "actor", "touch")


@query(L + """, c as (select actor, seq as valid_from, lead(seq) over (partition by actor order by seq) as valid_to, k % 2 + 2 as team from log where event = 'signup')
    select l.seq, l.actor, c.team from log l left join c on l.actor = c.actor and l.seq >= valid_from and (valid_to is null or l.seq < valid_to) where l.event = 'click'""")
def team_lookup_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    teams = correlate.intervals(log.where(_is("signup")).select("actor", "seq", (C("k") % 2 + 2).alias("team")), ACTOR, "seq")
    return correlate.looked_up(log.where(_is("click")).select("seq", "actor"), teams, ACTOR, "seq", ["team"])


@query(L + "select seq, count(*) filter (event = 'signup' and actor = 7) over (order by seq) as round_number from log qualify event = 'click'")
def event_to_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round that an event falls in, of all rounds of the log."""
    log = event_log(spark, sf_dir).select("seq", "event", (_is("signup") & (C("actor") == 7)).alias("start"))
    return runs.numbered(log, [], "seq", C("start"), "round_number").where(_is("click")).select("seq", "round_number")


@query(L + """select a.actor, r.day, coalesce(n, 0) as n, cast(coalesce(total, 0) as double) as total from (select distinct actor from log) a cross join (select distinct day from log) r
    left join (select actor, day, count(*) as n, sum(value) as total from log group by actor, day) s on s.actor = a.actor and s.day = r.day""")
def player_round_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    # actors and rounds of the one match are grouped under a constant key: an equi-join, no cross join
    match = F.lit(1).alias("match")
    actors, rounds = log.select(match, "actor").distinct(), log.select(match, "day").distinct()
    spine = correlate.spine(actors, rounds, ["match"]).drop("match")
    found = log.groupBy(*ROUND).agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))
    return stats.over_spine(spine, found, ROUND, ["n"]).withColumn("total", F.coalesce("total", F.lit(0.0)))


@query(L + """select coalesce(a.actor, b.actor) as actor, clicks, errors from (select actor, count(*) as clicks from log where event = 'click' group by actor) a
    full join (select actor, count(*) as errors from log where event = 'error' group by actor) b on a.actor = b.actor""")
def metrics_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    one = lambda e, n: log.where(_is(e)).groupBy("actor").agg(F.count("*").alias(n))
    return correlate.merged([one("click", "clicks"), one("error", "errors")], ACTOR)


@query(L + """, s as (select day, actor, side, cast(sum(value) as double) as v from log group by all)
    select a.day, a.actor, b.actor as other_actor, a.v >= b.v as ahead from s a join s b on a.day = b.day and a.side <> b.side and a.actor <> b.actor""")
def pair_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).groupBy("day", "actor", "side").agg(F.sum("value").cast("double").alias("v"))
    pairs = correlate.pairs(rows, ["day"], "actor", "side", ["v"], 64)
    return pairs.select("day", "actor", "other_actor", (C("v") >= C("other_v")).alias("ahead"))


@query(L + """, r as (select day, side, count(distinct actor) as roster from log group by day, side),
    k as (select day, seq, side, count(*) over (partition by day, side order by seq) as fallen from log where event = 'error')
    select k.day, k.seq, k.side, greatest(roster - fallen, 0) as alive from k join r using (day, side)""")
def alive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    roster = log.groupBy("day", "side").agg(F.count_distinct("actor").alias("roster"))
    w = Window.partitionBy("day", "side").orderBy("seq")
    fallen = log.where(_is("error")).select("day", "seq", "side", F.count("*").over(w).alias("fallen"))
    return fallen.join(roster, ["day", "side"]).select("day", "seq", "side", correlate.alive(C("roster"), C("fallen")).alias("alive"))


@query(L + "select actor, arg_max(k, seq) as k from log group by actor")
def entity_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.replay(event_log(spark, sf_dir), ACTOR, "seq", "k")


@query(L + "select actor, arg_max(k, seq) as k from log where seq <= (select max(seq) // 2 from log) group by actor")
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    half = log.agg(F.floor(F.max("seq") / 2).alias("h")).scalar()
    return entity.replay(log, ACTOR, "seq", "k", half)


@query(L + """select actor, before, after from (select actor, arg_max(k, seq) filter (seq <= m // 2) as before, arg_max(k, seq) as after from log, (select max(seq) as m from log) group by actor)
    where before is distinct from after""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors whose state at the middle of the log is not that at its end."""
    log = event_log(spark, sf_dir)
    last = log.agg(F.max("seq").alias("m"))
    return entity.difference(log, ACTOR, "seq", "k", last.select(F.floor(C("m") / 2)).scalar(), last.scalar())


@query(L + """select actor, seq, band from (select actor, seq, k // 50 as band, row_number() over w as n, lag(k // 50) over w as p from log window w as (partition by actor order by seq))
    where n = 1 or band is distinct from p""")
def cdc_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).select("actor", "seq", F.floor(C("k") / 50).cast("int").alias("band"))
    return entity.cdc(rows, ACTOR, SEQ, "band")


@query(L + """select actor, seq, case when now and not before then 'rising' else 'falling' end as edge from (select actor, seq, value > 50 as now, coalesce(lag(value > 50) over (partition by actor order by seq), false) as before from log)
    where now <> before""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).select("actor", "seq", (C("value") > 50).alias("high"))
    return entity.transitions(rows, ACTOR, SEQ, "high").select("actor", "seq", "edge")


@query(L + "select actor, k, seq, event from (select *, row_number() over (partition by actor, k order by seq) as n from log) where n = 1 and event <> 'error'")
def first_sighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.first_sighting(event_log(spark, sf_dir), ["actor", "k"], SEQ, ~_is("error")).select("actor", "k", "seq", "event")


@query(L + "select actor, seq from (select actor, seq, bool_or(event = 'error' and k >= 90) over (partition by actor order by seq) as broken from log) where not broken")
def freeze_on_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.until_broken(event_log(spark, sf_dir), ACTOR, SEQ, _is("error") & (C("k") >= 90)).select("actor", "seq")


@query(L + """select actor, max(case when event = 'view' then k end) as "view", max(case when event = 'click' then k end) as click, max(case when event = 'error' then k end) as error
    from (select actor, event, arg_max(k, seq) as k from log group by actor, event) group by actor""")
def player_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = entity.replay(event_log(spark, sf_dir), ["actor", "event"], "seq", "k")
    return entity.wide(state, ACTOR, "event", "k", ["view", "click", "error"])


@query(L + """select actor, day, grp, seq, k from (select actor, day, case when k % 4 = 0 then null else k % 4 end as grp, seq, k, max(k) over (partition by actor, day, case when k % 4 = 0 then null else k % 4 end) as best from log)
    where grp is null or k >= best""")
def group_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).select("actor", "day", F.when(C("k") % 4 != 0, C("k") % 4).alias("grp"), "seq", "k")
    return ranking.supersede(rows, ROUND, "grp", "k")


@query(L + f""", i as (select actor, day, seq, greatest(tick - {2 * HOUR}, epoch_us(day::timestamp)) as s, tick + {3 * HOUR} as e, event from log),
    n as (select *, case when s <= max(e) over (partition by actor, day order by s, seq rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from i),
    g as (select *, sum(new) over (partition by actor, day order by s, seq) as grp from n)
    select actor, day, min(s) as s, max(e) as e, string_agg(event, '+' order by s, seq) as titles from g group by actor, day, grp""")
def interval_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    midnight = F.floor(C("tick") / DAY) * DAY
    clips = event_log(spark, sf_dir).select("actor", "day", "seq", F.greatest(C("tick") - 2 * HOUR, midnight).alias("s"), (C("tick") + 3 * HOUR).alias("e"), "event")
    return ranking.coalesce_intervals(clips, ROUND, "s", "e", "event", SEQ).withColumn("titles", F.array_join("titles", "+"))


@query(L + f""", f as (select actor, day, min(tick) as first_tick from log where event = 'purchase' group by actor, day),
    m as (select seq, actor, tick, first_tick, epoch_us(day::timestamp) as rs, epoch_us(day::timestamp) + {DAY} as re from log join f using (actor, day) where event = 'purchase')
    select seq, actor, greatest(0, rs, least(tick - 6, first_tick)) as s, greatest(least(re, tick + 2), greatest(0, rs, least(tick - 6, first_tick)) + 1) as e from m""")
def clip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).where(_is("purchase"))
    first = F.min("tick").over(Window.partitionBy(*ROUND))
    start = F.floor(C("tick") / DAY) * DAY
    rows = log.withColumn("first_tick", first).withColumn("rs", start)
    s, e = ranking.clip_window(C("tick"), C("first_tick"), C("rs"), C("rs") + DAY, 6.5, 2.5, 1.0)
    return rows.select("seq", "actor", s.alias("s"), e.alias("e"))


@query(L + """, c as (select cast(k as varchar) as k, count(*) as n from log group by k), p as (select *, row_number() over (order by n desc, k) as place from c)
    select case when place <= 8 then k else 'other' end as k, least(place, 9) as place, cast(sum(n) as bigint) as n from p group by all""")
def top8_plus_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.top_with_rest(event_log(spark, sf_dir).select(C("k").cast("string").alias("k")), "k", 8)
    return found.withColumn("place", C("place").cast("long"))


@query(L + "select distinct event, levenshtein(event, 'clik') as distance from log where levenshtein(event, 'clik') <= 3")
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.suggestions(event_log(spark, sf_dir), "event", "clik").withColumn("distance", C("distance").cast("long"))


@query(L + "select seq, case event when 'view' then 1.5::double when 'click' then 2.0::double end as weight, [k, k + 1][3] as beyond, coalesce(case event when 'view' then 1.5 when 'click' then 2.0 end > 1.7, false) as heavy from log")
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = scalar.lookup({"view": 1.5, "click": 2.0}, C("event"))
    return event_log(spark, sf_dir).select("seq", weight.alias("weight"), scalar.item(F.array("k", C("k") + 1), 2).alias("beyond"), scalar.truth(weight > 1.7).alias("heavy"))


@query(L + """select seq, cast(floor(k / 60) as bigint) || ':' || lpad(cast(k % 60 as varchar), 2, '0') as clock, k / 64.0::double as seconds, event || ' by ' || actor || ' {{x}}' as title,
    event in ('view', 'click') as member, starts_with(event, 'c') as starts, contains(event, 'rch') as has, greatest(k, 50) as hi, least(k, 50) as lo, abs(k - 50) as dist, -k % 7 as rem from log""".replace("{{x}}", "{x}"))
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("k")
    return event_log(spark, sf_dir).select(
        "seq",
        scalar.clock(k, 1.0).alias("clock"),
        scalar.seconds(k, 64.0).alias("seconds"),
        scalar.title("{event} by {actor} {x}", {"event": C("event"), "actor": C("actor")}).alias("title"),
        C("event").isin("view", "click").alias("member"),
        C("event").startswith("c").alias("starts"),
        C("event").contains("rch").alias("has"),
        F.greatest(k, F.lit(50)).alias("hi"),
        F.least(k, F.lit(50)).alias("lo"),
        F.abs(k - 50).alias("dist"),
        (-k % 7).alias("rem"),
    )


@query(L + "select seq, tick, event from log where tick between epoch_us(timestamp '2024-01-03') and epoch_us(timestamp '2024-01-04') and event in ('click', 'purchase')")
def tick_range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).where(C("event").isin("click", "purchase"))
    from_us = 1_704_240_000_000_000  # 2024-01-03
    return log.where(C("tick").between(from_us, from_us + DAY)).select("seq", "tick", "event")


@query(L + """, d as (select seq, actor, day, k from log where event = 'error'), s as (select seq, actor, day, 100 - k as hp from log where event in ('error', 'signup'))
    select seq, actor, coalesce(hp, 100) as before, least(100 - k, coalesce(hp, 100)) as capped from (
    select seq, actor, event, k, last_value(case when event = 'error' then k when event = 'signup' then 100 end ignore nulls) over (partition by actor, day order by seq rows between unbounded preceding and 1 preceding) as hp from log) where event = 'error'""")
def running_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health before a hit is what the last hit of the round left, or full; damage beyond it does not count."""
    after = F.when(_is("error"), C("k")).when(_is("signup"), F.lit(100))
    rows = runs.state(event_log(spark, sf_dir), ROUND, SEQ, after, F.lit(100), before=True, out="before").where(_is("error"))
    return rows.select("seq", "actor", "before", F.least(100 - C("k"), C("before")).alias("capped"))


@query(L + """, o as (select day, seq, event, actor, row_number() over (partition by day order by seq) as n from log where event in ('error', 'purchase'))
    select day, seq, actor from o where n = 1 and event = 'purchase'""")
def opening_kill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round's first fall of any kind closes the gate; it counts if it is a purchase."""
    gate = event_log(spark, sf_dir).where(C("event").isin("error", "purchase"))
    first = gate.groupBy("day").agg(F.min_by(F.struct("seq", "actor", "event"), "seq").alias("f")).select("day", "f.*")
    return first.where(_is("purchase")).select("day", "seq", "actor")


@query(L + """, r as (select day, count(*) filter (side = 2 and event = 'error') as a, count(*) filter (side = 3 and event = 'error') as b, bool_or(event = 'purchase' and k > 97) as x from log group by day)
    select day, case when x then 2 when a > b then 3 when b > a then 2 else 3 end as winner_side from r""")
def derived_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round's winner: a decisive event, else the side that lost less, else side 3."""
    fallen = lambda side: F.count_if((C("side") == side) & _is("error"))
    r = event_log(spark, sf_dir).groupBy("day").agg(fallen(2).alias("a"), fallen(3).alias("b"), F.bool_or(_is("purchase") & (C("k") > 97)).alias("x"))
    return r.select("day", F.when(C("x"), 2).when(C("a") > C("b"), 3).when(C("b") > C("a"), 2).otherwise(3).alias("winner_side"))
