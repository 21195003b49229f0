"""Derived columns of a match log: rounds, ambient state, teams, and what makes a kill a trade.

A match's team changes and a round's deaths are short arrays (players times
changes, and one entry for each death), so what is known about a player at an
event is a filter over the array of its match or round: each is one aggregate
and one equi-join, with no join for each player column.  Everything that a round
resets is windowed by (match, segment, round), so one long match is many
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.scalar import fires_bullets, truth
from matchloom.operators import correlate, runs
from matchloom.rules.catalog import MATCH

# Windows in ticks, and the event names that matter here.
TRADE, FLASH, SPRAY, RECOIL, FULL = 256, 320, 24, 0.25, 100
ENDS = ["round_officially_ended", "cs_win_panel_match"]
ROLES = ("Attacker", "UserId", "Assister")
ROUND = ["match_id", "segment", "round_number"]
# What an event turns a state into.
PHASES = {
    "warmup_end": "PreMatch", "round_announce_match_start": "PreMatch", "round_prestart": "FreezeTime", "round_freeze_end": "ActiveWithBuy", "buytime_ended": "ActivePostBuy",
    "cs_round_final_beep": "PostRound", "round_officially_ended": "PreRound", "cs_pre_restart": "PreRound", "halftime": "Halftime", "cs_intermission": "Intermission", "cs_win_panel_match": "PostMatch",
}
BOMB = {
    "bomb_pickup": "Carried", "bomb_dropped": "Dropped", "bomb_beginplant": "Planting", "bomb_planted": "Planted", "bomb_abortplant": "Carried",
    "bomb_begindefuse": "Defusing", "bomb_defused": "Defused", "bomb_abortdefuse": "Planted", "bomb_exploded": "Detonated",
}
# What is known of a player's entity, and which of it is 0 as long as it was not seen.
STATE = {"health": "long", "armor": "long", "equipment": "long", "active_weapon": "string", "active_weapon_clip": "long", "place": "string"}
UNSEEN = ("armor", "equipment")
HALF_ENDS = ["round_officially_ended", "cs_pre_restart"]
_SPARK = {"int": "long", "instant": "long", "float": "double", "bool": "boolean", "string": "string"}


def completed(log: DataFrame) -> DataFrame:
    """The log with every payload column of the match vocabulary; missing ones are null."""
    have = set(log.columns)
    return log.select("*", *[F.lit(None).cast(_SPARK[t]).alias(c) for c, t in MATCH.event.items() if c not in have], *([] if "map_name" in have else [F.lit(None).cast("string").alias("map_name")]))


def contexts(log: DataFrame) -> DataFrame:
    """What phase a match is in, from a log with segments and rounds; each state is that after the event.

    rounds_after_half_announce: -1 until the last round of a half is announced, then rounds begun since; at the end of
    the round that makes it 1 the half is over.
    """
    e = F.col("event")
    of = lambda names: F.coalesce(*[F.when(e == k, F.lit(v)) for k, v in names.items()])
    match = Window.partitionBy("match_id").orderBy("seq")
    segment = Window.partitionBy("match_id", "segment").orderBy("seq")
    held = lambda now, w, first: F.coalesce(F.last(now, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(first))
    announced = F.last(F.when(e == "round_announce_last_round_half", F.col("round_number")), ignorenulls=True).over(segment.rowsBetween(Window.unboundedPreceding, 0))
    log = log.withColumn("rounds_after_half_announce", F.coalesce(F.col("round_number") - announced, F.lit(-1)))
    half = e.isin(HALF_ENDS) & (F.col("rounds_after_half_announce") == 1)
    return log.withColumns(
        {
            "gameplay_phase": held(F.when(half, "Halftime").otherwise(of(PHASES)), match, "WarmUp"),
            "half_state": held(F.when(half | (e == "halftime"), "SecondHalf"), segment, "FirstHalf"),
            "regulation_status": held(F.when(e == "cs_match_end_restart", "Overtime"), match, "Regulation"),
            "bomb_status": held(of(BOMB), Window.partitionBy(*ROUND).orderBy("seq"), "NotInPlay"),
        }
    )


def _last(items: str, slot: Column, value: str) -> Column:
    """Value of the last entry of ``slot`` before the row."""
    own = F.filter(items, lambda x: (x["slot"] == slot) & (x["seq"] < F.col("seq")))
    return F.try_element_at(own, F.lit(-1))[value]


def _dead(slot: Column, deaths: str = "deaths") -> Column:
    return truth(F.exists(deaths, lambda d: (d["slot"] == slot) & (d["seq"] < F.col("seq")) & ~d["self"]))


def roster(log: DataFrame, players: DataFrame, most: int = 63) -> DataFrame:
    """``players`` and those of slots 0 to ``most`` that are first seen in events; what is not known of them is null."""
    roles = [c for c in ROLES if c in log.columns]
    seen = log.select("match_id", F.explode(F.array(*[F.col(c).cast("long") for c in roles])).alias("player")).where(F.col("player").between(0, most)).distinct()
    return players.unionByName(seen.join(players.select("match_id", "player"), ["match_id", "player"], "left_anti"), allowMissingColumns=True)


def enrich(log: DataFrame, players: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """``log``: match_id, seq, tick, event and payload; ``players``: match_id, player, team; ``state``: match_id, player,
    seq and columns of ``STATE``, a row for each change, null where a column does not change.

    Returns the log with all columns that the match catalog names.  What ``state`` does not tell is null unless the log
    has it; armor and equipment that were never seen are 0.
    """
    log = completed(log)
    e = F.col("event")
    death, hurt, landed = e == "player_death", e == "player_hurt", e == "bullet_damage"
    log = runs.rounds(log, ["match_id"], ["seq"], e == "round_freeze_end", e == "begin_new_match")
    whole = Window.partitionBy("match_id")
    started = (F.col("segment") > 0) | (F.max("segment").over(whole) == 0)
    segment = Window.partitionBy("match_id", "segment").orderBy("seq")
    ended = F.coalesce(F.count_if(e == "cs_win_panel_match").over(segment.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    log = contexts(log.withColumn("match_live", started & ~ended))
    w = Window.partitionBy(*ROUND).orderBy("seq")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    log = log.withColumns(
        {
            "no_deaths_yet": F.coalesce(F.count_if(death).over(before), F.lit(0)) == 0,
            "bomb_was_planted": F.count_if(e == "bomb_planted").over(upto) > 0,
            "round_active": (F.col("round_number") > 0) & (F.coalesce(F.count_if(e.isin(ENDS)).over(before), F.lit(0)) == 0),
        }
    )
    # teams: the roster's first, then every change
    start = players.select("match_id", F.col("player").cast("long").alias("slot"), F.lit(-1).cast("long").alias("seq"), F.col("team").cast("long").alias("team"))
    moved = log.where((e == "player_team") & F.col("UserId").isNotNull()).select("match_id", F.col("UserId").cast("long").alias("slot"), F.col("seq").cast("long"), F.col("Team").cast("long").alias("team"))
    teams = start.unionByName(moved).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("seq", "slot", "team"))).alias("teams"))
    log = log.join(teams, "match_id", "left")
    fallen = log.where(death).groupBy(*ROUND).agg(F.array_sort(F.collect_list(F.struct("seq", F.col("UserId").cast("long").alias("slot"), truth(F.col("UserId") == F.col("Attacker")).alias("self")))).alias("deaths"))
    log = log.join(fallen, ROUND, "left")
    log = log.withColumns({f"{r}_team": _last("teams", F.col(r), "team") for r in ROLES})
    log = log.withColumns({f"{r}_alive": ~_dead(F.col(r)) for r in ROLES})
    k, v, a = (F.coalesce(F.col(f"{r}_team"), F.lit(0)) for r in ROLES)
    own = truth(F.col("Attacker") == F.col("UserId"))
    mates = (k > 1) & (k == v)
    apart = (k > 1) & (v > 1) & (k != v)
    log = log.withColumns(
        {
            "kill_was_self_kill": death & own,
            "kill_was_team_kill": death & ~own & mates,
            "kill_was_enemy_kill": death & ~own & ~mates,
            "kill_was_enemy_assist": death & (a > 1) & (v > 1) & (a != v),
            "hurt_was_self_damage": hurt & own,
            "hurt_was_team_damage": hurt & ~own & mates,
            "hurt_was_enemy_damage": hurt & ~own & ~mates,
            "blind_was_enemy_flash": (e == "player_blind") & apart,
            "shot_is_bullet": (e == "weapon_fire") & fires_bullets(F.col("Weapon")),
        }
    ).withColumn("blind_duration", F.when(F.col("blind_was_enemy_flash"), F.col("BlindDuration")).otherwise(F.lit(0.0)))
    # victims: health before a hit, and the last enemy flash
    victim = Window.partitionBy(*ROUND, "UserId").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    health = F.last(F.when(hurt, F.when(F.col("Health") > 0, F.col("Health")).otherwise(F.lit(FULL))), ignorenulls=True).over(victim)
    flash = F.last(F.when(F.col("blind_was_enemy_flash"), F.struct("Attacker", "tick", F.col("Attacker_team").alias("team"))), ignorenulls=True).over(victim)
    log = log.withColumns({"hurt_victim_health_before": F.when(hurt, F.coalesce(health, F.lit(FULL))).otherwise(F.lit(0)), "_flash": flash})
    flashed = death & ~own & truth((F.col("tick") - F.col("_flash.tick") <= FLASH) & (F.col("_flash.team") == k))
    log = log.withColumns(
        {
            "hurt_capped_damage": F.when(hurt & (F.col("Health") <= 0), F.least("DmgHealth", "hurt_victim_health_before")).when(hurt, F.col("DmgHealth")).otherwise(F.lit(0)),
            "kill_was_flash_kill": flashed,
            "kill_flash_attacker_slot": F.when(flashed, F.col("_flash.Attacker")).otherwise(F.lit(-1)),
        }
    )
    # attackers: pellets of one shot, and sprays
    hit = hurt & ~own & fires_bullets(F.col("Weapon"))
    by = Window.partitionBy("match_id", "Attacker").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    same = F.last(F.when(hit, F.struct("tick", "UserId")), ignorenulls=True).over(by)
    log = log.withColumn("hurt_is_bullet", hit & ~truth(same == F.struct("tick", "UserId")))
    shots = log.where(landed).select(*ROUND, "Attacker", "Victim", "seq", "tick", "ShootAngX", "ShootAngY", "RecoilIndex")
    mine, order = [*ROUND, "Attacker"], ["seq"]
    x = Window.partitionBy(*mine).orderBy(*order)
    shots = runs.since_last(shots, mine, order, "tick", out="shot_ticks_since_last_shot")
    shots = runs.turn(shots, mine, order, "ShootAngX", "ShootAngY", "shot_turn_degrees")
    shots = runs.islands(shots, mine, order, "tick", SPRAY, broken=F.col("RecoilIndex") < F.lag("RecoilIndex").over(x) - RECOIL)
    inside = Window.partitionBy(*mine, "island").orderBy("seq")
    shots = shots.withColumns({"shot_spray_shots": F.row_number().over(inside), "shot_spray_victims": F.size(F.collect_set("Victim").over(inside))})
    log = log.join(shots.select("match_id", "seq", *[c for c in shots.columns if c.startswith("shot_")]), ["match_id", "seq"], "left")
    spray = Window.partitionBy(*ROUND, "Attacker").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(landed, F.struct("tick", "shot_spray_shots")), ignorenulls=True).over(spray)
    log = log.withColumn("_spray", last)
    near = death & truth(F.col("tick") - F.col("_spray.tick") <= SPRAY)
    log = log.withColumn("kill_spray_shots_at_kill", F.when(near, F.col("_spray.shot_spray_shots")).otherwise(F.lit(0)))
    # kills so far that fell into the run that the attacker is in
    run = Window.partitionBy(*ROUND, "Attacker", F.col("_spray.tick") - F.col("_spray.shot_spray_shots")).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    log = log.withColumn("kill_spray_kills", F.when(near, F.count_if(near).over(run)).otherwise(F.lit(0)))
    # trades, against the deaths of the same round
    deaths = log.where(death).select(*ROUND, "seq", "tick", F.col("UserId").alias("victim"), F.col("Attacker").alias("killer"), F.col("UserId_team").alias("victim_team"), F.col("Attacker_team").alias("killer_team"))
    traded = correlate.trades(deaths, ROUND, "tick", TRADE, "team").select("match_id", "seq", F.col("traded").alias("kill_traded_player_slot"))
    log = log.join(traded, ["match_id", "seq"], "left").withColumn("kill_was_trade_kill", F.col("kill_traded_player_slot").isNotNull())
    log = log.withColumn("kill_traded_player_slot", F.coalesce("kill_traded_player_slot", F.lit(-1)))
    return observed(_sides(_resolved(log)), state).drop("_flash", "_spray", "teams", "deaths")


def observed(log: DataFrame, state: DataFrame | None) -> DataFrame:
    """For each role the state of its player before the event, and each side's equipment when its round went live."""
    have = [] if state is None else [c for c in STATE if c in state.columns]
    if have:
        # only a living player's health counts
        seen = {c: F.when(F.col(c) > 0, F.col(c)) if c == "health" else F.col(c) for c in have}
        state = state.select("match_id", F.col("player").cast("long").alias("_slot"), F.col("seq").cast("long").alias("seq"), *[x.cast(STATE[c]).alias(c) for c, x in seen.items()])
    for r in ROLES:
        if have:
            own = log.drop(*[f"{r}_{c}" for c in have]).withColumn("_slot", F.coalesce(F.col(r).cast("long"), F.lit(-1)))
            log = correlate.as_of(own, state, ["match_id", "_slot"], "seq", have, prefix=f"{r}_").drop("_slot")
        missing = {f"{r}_{c}": F.lit(None).cast(t) for c, t in STATE.items() if f"{r}_{c}" not in log.columns}
        log = log.withColumns(missing) if missing else log
        log = log.withColumns({f"{r}_{c}": F.coalesce(f"{r}_{c}", F.lit(0)) for c in UNSEEN})
    if "equipment" in have:
        moves = F.filter("teams", lambda t: t["seq"] < F.col("seq"))
        last = F.filter(moves, lambda t: ~F.exists(moves, lambda u: (u["slot"] == t["slot"]) & (u["seq"] > t["seq"])))
        at = log.where(F.col("event") == "round_freeze_end").select(*ROUND, "seq", F.inline(F.transform(last, lambda t: F.struct(t["slot"].alias("_slot"), t["team"].alias("_team")))))
        worth = correlate.as_of(at, state, ["match_id", "_slot"], "seq", ["equipment"]).groupBy(*ROUND, "_team").agg(F.coalesce(F.sum("equipment"), F.lit(0)).alias("_sum"))
        log = log.join(worth.groupBy(*ROUND).agg(F.map_from_entries(F.collect_list(F.struct("_team", "_sum"))).alias("_worth")), ROUND, "left")
    else:
        log = log.withColumn("_worth", F.lit(None).cast("map<bigint,bigint>"))
    sums = {}
    for r in ROLES:
        team = F.coalesce(F.col(f"{r}_team").cast("long"), F.lit(0).cast("long"))
        for name, side in (("team", team), ("enemies", F.when(team == 2, 3).when(team == 3, 2).otherwise(-1).cast("long"))):
            sums[f"{r}_{name}_equipment"] = F.coalesce(F.try_element_at("_worth", side), F.lit(0))
    return log.withColumns(sums).drop("_worth")


def _sides(log: DataFrame) -> DataFrame:
    """For each role: players and living players of its player's team and of the other one, before the event.

    Computed for the rows and columns that a plan reads; a match's roster and a round's deaths are short arrays.
    """
    moves = F.filter("teams", lambda t: t["seq"] < F.col("seq"))
    current = F.map_from_entries(F.array_distinct(F.transform(moves, lambda t: F.struct(t["slot"], F.element_at(F.filter(moves, lambda u: u["slot"] == t["slot"]), -1)["team"]))))
    fallen = F.coalesce(F.transform(F.filter("deaths", lambda d: (d["seq"] < F.col("seq")) & ~d["self"]), lambda d: d["slot"]), F.array().cast("array<bigint>"))
    log = log.withColumns({"_current": current, "_fallen": fallen})
    out = {}
    for r in ROLES:
        for name, same in (("team", True), ("enemies", False)):
            side = F.col(f"{r}_team") if same else F.when(F.col(f"{r}_team") == 2, 3).when(F.col(f"{r}_team") == 3, 2).otherwise(0)
            players = F.map_keys(F.map_filter("_current", lambda _, t: t == side))  # noqa: B023
            out[f"{r}_{name}_players"] = F.coalesce(F.size(players), F.lit(0))
            out[f"{r}_{name}_alive"] = F.coalesce(F.size(F.array_except(players, F.col("_fallen"))), F.lit(0))
    log = log.withColumns(out)
    clutch = {f"{r}_in_clutch": truth((F.col(f"{r}_team_alive") == 1) & (F.col(f"{r}_enemies_alive") >= 1) & F.col(f"{r}_alive")) for r in ROLES}
    size = {f"{r}_clutch_size": F.when(F.col(f"{r}_in_clutch"), F.col(f"{r}_enemies_alive")).otherwise(0) for r in ROLES}
    return log.withColumns(clutch).withColumns(size).drop("_current", "_fallen")


def _resolved(log: DataFrame) -> DataFrame:
    """Clutches and round winners, from who is alive on each side."""
    e = F.col("event")
    now = F.aggregate(F.filter("teams", lambda t: t["seq"] < F.col("seq")), F.create_map().cast("map<bigint,bigint>"), lambda m, t: F.map_concat(F.map_filter(m, lambda k, _: k != t["slot"]), F.create_map(t["slot"], t["team"])))
    gone = F.coalesce(F.transform(F.filter("deaths", lambda d: (d["seq"] <= F.col("seq")) & ~d["self"]), lambda d: d["slot"]), F.array().cast("array<bigint>"))
    marks = e.isin("player_death", *ENDS)
    log = log.withColumns({"_now": F.when(marks, now), "_gone": F.when(marks, gone)})
    left = lambda side: F.map_keys(F.map_filter("_now", lambda k, t: (t == side) & ~F.array_contains("_gone", k)))
    log = log.withColumns({"_t": left(2), "_ct": left(3)})
    own = F.when(F.col("UserId_team") == 2, F.col("_t")).when(F.col("UserId_team") == 3, F.col("_ct"))
    other = F.when(F.col("UserId_team") == 2, F.col("_ct")).when(F.col("UserId_team") == 3, F.col("_t"))
    alone = (e == "player_death") & ~F.col("kill_was_self_kill") & truth((F.size(own) == 1) & (F.size(other) >= 1))
    log = log.withColumn("_clutch", F.when(alone, F.get(own, F.lit(0))))
    w = Window.partitionBy(*ROUND).orderBy("seq")
    known = F.collect_set("_clutch").over(w.rowsBetween(Window.unboundedPreceding, -1))
    log = log.withColumn("_in", F.coalesce(known, F.array().cast("array<bigint>")))
    first = F.col("_clutch").isNotNull() & ~truth(F.array_contains("_in", F.col("_clutch")))
    bomb = lambda name: F.coalesce(F.count_if(e == name).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) > 0
    t, ct = F.size("_t") > 0, F.size("_ct") > 0
    side = F.when(bomb("bomb_exploded"), 2).when(bomb("bomb_defused"), 3).when(truth(t & ~ct), 2).otherwise(3)
    end = e.isin(ENDS) & (F.col("round_number") > 0)
    stand = F.filter("_in", lambda p: F.array_contains("_t", p) | F.array_contains("_ct", p))
    return log.withColumns(
        {
            "kill_clutch_detected": first,
            "kill_clutch_player_slot": F.when(first, F.col("_clutch")).otherwise(F.lit(-1)),
            "round_has_winner": end,
            "round_winner_side": F.when(end, side).otherwise(F.lit(0)),
            "clutch_won": end & truth(F.size(stand) > 0),
            "clutch_winner_slot": F.when(end & truth(F.size(stand) > 0), F.get(stand, F.lit(0))).otherwise(F.lit(-1)),
        }
    ).drop("_now", "_gone", "_t", "_ct", "_clutch", "_in")


def player_rounds(log: DataFrame, players: DataFrame) -> DataFrame:
    """match_id, player, round_number, player_survived, player_traded of an enriched log."""
    rounds = log.where("round_number > 0").groupBy("match_id", "round_number").agg(
        F.collect_set(F.when((F.col("event") == "player_death") & ~F.col("kill_was_self_kill"), F.col("UserId").cast("long"))).alias("_dead"),
        F.collect_set(F.when(F.col("kill_was_trade_kill"), F.col("kill_traded_player_slot").cast("long"))).alias("_traded"),
        F.bool_or(F.col("event").isin(ENDS)).alias("_over"),
    )
    p = F.col("player").cast("long")
    return players.join(rounds, "match_id").select(
        "match_id", "player", "round_number", (F.col("_over") & ~F.array_contains("_dead", p)).alias("player_survived"), F.array_contains("_traded", p).alias("player_traded")
    )
