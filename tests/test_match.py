"""Enrichments and rulesets over a small match log that is written out by hand."""

import pytest
from pyspark.sql import functions as F

from matchloom.lang.diagnostics import RuleError
from matchloom.operators.enrich import enrich, player_rounds, roster
from matchloom.plans import outputs
from matchloom.plans.ruleset import Planner
from matchloom.rules import model
from matchloom.rules.catalog import MATCH

COLUMNS = "match_id string, seq long, tick long, event string, UserId long, Attacker long, Assister long, Weapon string, Headshot boolean, DmgHealth long, Health long, BlindDuration double, Victim long, RecoilIndex double, ShootAngX double, ShootAngY double"


def _log(rows):
    out = []
    for seq, (tick, event, kw) in enumerate(rows):
        r = dict.fromkeys(c.split(" ")[0] for c in COLUMNS.split(", "))
        out.append(tuple((r | {"match_id": "m", "seq": seq, "tick": tick, "event": event, "Assister": -1} | kw).values()))
    return out


def _kill(tick, killer, victim, **kw):
    return tick, "player_death", {"Attacker": killer, "UserId": victim, "Weapon": "ak47", "Headshot": False} | kw


ROWS = [
    (0, "round_freeze_end", {}),
    (10, "player_hurt", {"Attacker": 1, "UserId": 6, "DmgHealth": 60, "Health": 40, "Weapon": "ak47"}),
    (10, "player_hurt", {"Attacker": 1, "UserId": 6, "DmgHealth": 60, "Health": 40, "Weapon": "ak47"}),
    (20, "player_hurt", {"Attacker": 1, "UserId": 6, "DmgHealth": 90, "Health": 0, "Weapon": "ak47"}),
    _kill(20, 1, 6, Headshot=True, Assister=2),
    _kill(276, 7, 1),  # avenges 6, at the last tick
    _kill(533, 2, 7),  # one tick too late for 1
    (540, "player_blind", {"Attacker": 2, "UserId": 8, "BlindDuration": 2.5}),
    _kill(860, 2, 8, Weapon="deagle"),  # 320 ticks after the flash
    _kill(870, 3, 3),  # suicide
    (900, "round_officially_ended", {}),
    (1000, "round_freeze_end", {}),
    (1010, "bullet_damage", {"Attacker": 6, "Victim": 1, "RecoilIndex": 0.0, "ShootAngX": 0.0, "ShootAngY": 0.0}),
    (1034, "bullet_damage", {"Attacker": 6, "Victim": 2, "RecoilIndex": 1.0, "ShootAngX": 0.0, "ShootAngY": 90.0}),
    (1059, "bullet_damage", {"Attacker": 6, "Victim": 2, "RecoilIndex": 2.0, "ShootAngX": 0.0, "ShootAngY": 90.0}),
    (1060, "bomb_planted", {"UserId": 1}),
    _kill(1061, 6, 1),
    _kill(1062, 6, 7),  # team kill
    (1100, "cs_win_panel_match", {}),
]


@pytest.fixture(scope="module")
def match(spark):
    log = spark.createDataFrame(_log(ROWS), COLUMNS)
    players = spark.createDataFrame([("m", p, 2 if p < 5 else 3, f"p{p}") for p in (1, 2, 3, 6, 7, 8, 9)], "match_id string, player long, team int, player_name string")
    return enrich(log, players).cache(), players


def _at(match, *columns):
    return {r["seq"]: tuple(r[c] for c in columns) for r in match[0].select("seq", *columns).collect()}


def test_kills(match):
    got = _at(match, "kill_was_enemy_kill", "kill_was_trade_kill", "kill_traded_player_slot", "kill_was_flash_kill")
    assert got[4] == (True, False, -1, False)
    assert got[5] == (True, True, 6, False)
    assert got[6] == (True, False, -1, False)
    assert got[8] == (True, False, -1, True)
    assert _at(match, "kill_was_self_kill")[9] == (True,)
    assert _at(match, "kill_was_team_kill")[17] == (True,)
    assert got[0] == (False, False, -1, False)


def test_damage(match):
    got = _at(match, "hurt_victim_health_before", "hurt_capped_damage", "hurt_is_bullet")
    assert got[1] == (100, 60, True)
    assert got[2] == (40, 60, False)  # the same shot
    assert got[3] == (40, 40, True)


def test_sprays(match):
    got = _at(match, "shot_ticks_since_last_shot", "shot_spray_shots", "shot_spray_victims", "shot_turn_degrees")
    assert got[12] == (1_000_000, 1, 1, 0.0)
    assert got[13][:3] == (24, 2, 2) and abs(got[13][3] - 90) < 1e-9
    assert got[14][:3] == (25, 1, 1)


def test_rounds(match):
    got = _at(match, "round_number", "no_deaths_yet", "bomb_was_planted", "round_winner_side")
    assert got[4][:2] == (1, True) and got[5][:2] == (1, False)
    assert got[15][2] is True and got[11][2] is False
    assert got[10][3] == 2 or got[10][3] == 3
    rounds = {(r["player"], r["round_number"]): (r["player_survived"], r["player_traded"]) for r in player_rounds(*match).collect()}
    assert rounds[6, 1] == (False, True)
    assert rounds[3, 1][0] is True  # a suicide does not clear it
    assert rounds[9, 2] == (True, False)


RULES = """
ruleset: base
exports: [pct]
stats:
  enemy: { count: kill, match: { enemy: true }, per: round }
  total: { count: kill, match: { enemy: true } }
  deaths: { count: death, per: round }
  dmg: { sum: enrich.hurt.capped_damage, on: damage_dealt, match: { enemy: true } }
  assists: { count: assist, match: { enemy: true } }
  flashes: { count: kill, match: { actor: any, flash_assisted: true }, where: "enrich.kill.flash_attacker_slot == player.slot" }
  plants: { count: bomb_planted, where: "event.UserId == player.slot" }
  ended: { count: round_won }
  opening: { flag: true, on: kill, while: round.no_deaths_yet, per: round }
  kast: { flag: { when: "enemy > 0 or player.survived or player.traded" }, per: round }
  pct: { compute: "good.count / round.number * 100", format: F2 }
  multi: { tally: enemy, thresholds: [ { min: 2, target: doubles }, { min: 1, target: singles } ] }
  guns: { bucket: kill, key: event.Weapon }
highlights:
  good: { when: kast, per: match, kind: hidden }
  double: { when: enemy >= 2, title: "{enemy} in round {round.number}" }
---
ruleset: next
use: [base]
stats:
  half: { compute: "base.pct / 2", format: F2 }
"""


def test_ruleset(match):
    log, players = match
    reports = Planner(log, players, MATCH, player_rounds=player_rounds(log, players)).run(model.read(RULES))
    game = {r["player"]: r for r in reports["base"].game.collect()}
    assert {p: game[p]["total"] for p in game} == {1: 1, 2: 2, 3: 0, 6: 1, 7: 1, 8: 0, 9: 0}
    assert game[1]["dmg"] == 160 and game[2]["assists"] == 1 and game[2]["flashes"] == 1 and game[1]["plants"] == 1
    assert all(r["ended"] == 2 for r in game.values())
    assert (game[2]["doubles"], game[2]["singles"], game[1]["singles"]) == (1, 0, 1)
    assert game[9]["pct"] == 100.0 and game[8]["pct"] == 50.0
    rounds = {(r["player"], r["round_number"]): r for r in reports["base"].rounds.collect()}
    assert rounds[1, 1]["opening"] and not rounds[7, 1]["opening"] and rounds[9, 1]["deaths"] == 0
    moments = reports["base"].moments.collect()
    assert [(m["highlight"], m["player"], m["seq"], m["title"]) for m in moments] == [("double", 2, 8, "2 in round 1")]
    guns = {(r["player"], r["key"]): r["value"] for r in reports["base"].keyed["guns"].collect()}
    assert guns == {(1, "ak47"): 1, (7, "ak47"): 1, (2, "ak47"): 1, (2, "deagle"): 1, (6, "ak47"): 2}
    assert {r["player"]: r["half"] for r in reports["next"].game.select("player", F.col("half")).collect()}[9] == 50.0


def test_rounds_and_clips(match):
    from matchloom.plans import outputs

    log, players = match
    rounds = outputs.rounds(log)
    assert {r["round_number"]: (r["start"], r["end"]) for r in rounds.collect()} == {1: (0, 900), 2: (1000, 1100)}
    reports = Planner(log, players, MATCH, player_rounds=player_rounds(log, players)).run(model.read(RULES))
    clips = outputs.clips(reports["base"].moments, rounds, players, rate=64.0).collect()
    assert [(c["player_name"], c["start"], c["end"], c["titles"]) for c in clips] == [("p2", 540, 900, ["2 in round 1"])]
    doc = outputs.documents(reports["base"].game, {"total": "kills"}).collect()
    assert '{"player":"2","kills":2.0}' in doc[0]["players"]


def test_profiles(match):
    from matchloom.rules.catalog import Catalog, View
    from matchloom.rules.profiles import PROFILES, Profile, pick, resolved, restarts

    own = [*PROFILES, Profile("late", "gotv", (100, 200), {"$round_end": ("x",)})]
    assert pick(own, "gotv", 150).name == "late" and pick(own, "gotv", 99).name == "gotv" and pick(own, "none", 1) is None
    catalog, missing = resolved(Catalog({"a": View(("$round_end", "b")), "c": View(("$none",))}, {}), own[-1])
    assert catalog.views["a"].events == ("x", "b") and missing == ["c"]
    assert restarts(match[0]).collect() == []


@pytest.fixture(scope="module")
def phases(spark):
    rows = [
        (0, "warmup_end", {}), (1, "begin_new_match", {}), (2, "round_prestart", {}), (3, "round_freeze_end", {}),
        (4, "bomb_pickup", {"UserId": 1}), (5, "bomb_beginplant", {"UserId": 1}), (6, "bomb_abortplant", {"UserId": 1}), _kill(7, 1, 6), (8, "bomb_planted", {"UserId": 1}),
        (9, "cs_round_final_beep", {}), (10, "round_officially_ended", {}), (11, "round_announce_last_round_half", {}), (12, "round_freeze_end", {}),
        _kill(13, 6, 1), (14, "round_officially_ended", {}), (15, "round_freeze_end", {}), (16, "player_hurt", {"Attacker": 1, "UserId": 7, "DmgHealth": 5, "Health": 95, "Weapon": "ak47"}),
        (17, "cs_win_panel_match", {}), (18, "cs_intermission", {}), (19, "begin_new_match", {}), (20, "round_freeze_end", {}),
    ]
    log = spark.createDataFrame(_log(rows), COLUMNS)
    players = spark.createDataFrame([("m", p, 2 if p < 5 else 3) for p in (1, 2, 6, 7)], "match_id string, player long, team int")
    state = [("m", 1, 2, 100, 50, 800, "weapon_ak47", 30, "Long"), ("m", 1, 11, None, None, 1000, None, None, None), ("m", 2, 2, 100, None, 300, None, None, None), ("m", 6, 2, 100, None, 50, "weapon_awp", 5, "Pit"), ("m", 6, 6, 0, 7, None, None, 4, None)]
    state = spark.createDataFrame(state, "match_id string, player long, seq long, health long, armor long, equipment long, active_weapon string, active_weapon_clip long, place string")
    return enrich(log, players, state).cache(), players


def test_contexts(phases):
    got = _at(phases, "match_live", "gameplay_phase", "half_state", "bomb_status", "rounds_after_half_announce")
    assert got[0] == (False, "PreMatch", "FirstHalf", "NotInPlay", -1)
    assert got[2][1] == "FreezeTime" and got[3] == (True, "ActiveWithBuy", "FirstHalf", "NotInPlay", -1)
    assert [got[k][3] for k in (4, 5, 6, 7, 8, 9)] == ["Carried", "Planting", "Carried", "Carried", "Planted", "Planted"]
    assert got[9][1] == "PostRound" and got[10][1] == "PreRound" and got[11][4] == 0
    # the last round of the half ends
    assert got[12][4] == 1 and got[12][3] == "NotInPlay" and got[14] == (True, "Halftime", "SecondHalf", "NotInPlay", 1)
    assert got[15][4] == 2 and got[17][0] is True and got[18][:2] == (False, "Intermission")
    assert got[19] == (True, "Intermission", "FirstHalf", "NotInPlay", -1)


def test_sides_and_state(phases):
    got = _at(phases, "Attacker_team_alive", "Attacker_enemies_alive", "UserId_enemies_players", "Attacker_team_equipment", "Attacker_enemies_equipment")
    assert got[7] == (2, 2, 2, 1100, 50)
    assert got[13] == (2, 2, 2, 50, 1300)
    assert got[16][:3] == (2, 2, 2)
    got = _at(phases, "Attacker_health", "Attacker_armor", "Attacker_active_weapon", "Attacker_active_weapon_clip", "UserId_health", "UserId_armor", "UserId_place", "UserId_active_weapon_clip")
    # health of 0 does not count; armor that was never seen is 0
    assert got[7] == (100, 50, "weapon_ak47", 30, 100, 7, "Pit", 4) and got[16][4:] == (None, 0, None, None)


def test_roles_in_rules(phases):
    log, players = phases
    doc = """
ruleset: roles
stats:
  pit: {count: kill, where: victim.place == 'Pit' and killer.active_weapon_clip > 10}
  armed: {count: kill, where: player.equipment_value >= 800 and round.enemies.alive == 2 and round.gameplay_phase == 'ActiveWithBuy'}
  rich: {count: kill, where: round.team.equipment > round.enemies.equipment}
  carried: {sum: event.DmgHealth, on: damage_dealt, where: enrich.hurt.attacker_active_weapon == 'weapon_ak47'}
"""
    report = Planner(log, players, MATCH).run(model.read(doc))["roles"].game
    assert {r["player"]: (r["pit"], r["armed"], r["rich"], int(r["carried"])) for r in report.collect()} == {1: (1, 1, 1, 5), 2: (0, 0, 0, 0), 6: (0, 0, 0, 0), 7: (0, 0, 0, 0)}


def test_flags_off_and_their_edges(phases):
    log, players = phases
    doc = """
ruleset: edges
stats:
  armed: {flag: true, on: kill, off: death, per: match}
  again: {count: armed}
  one: {count: kill}
  two: {count: kill}
  hurt: {flag: true, on: damage_dealt, per: round}
  hurts: {count: hurt}
highlights:
  any: {when: one_round >= 1, title: x}
  fresh: {when: one_round == 1, title: y}
show:
  tables:
    t: {per: player_match, columns: [{stat: any}, {stat: two}]}
    e: {per: event, columns: [{stat: highlight}, {stat: tick}]}
  scoreboard: [{stat: any}]
"""
    doc = doc.replace("  one: {", "  one_round: {count: kill, per: round}\n  one: {")
    planner = Planner(log, players, MATCH)
    report = planner.run(model.read(doc))["edges"]
    got = {r["player"]: r for r in report.game.collect()}
    # 1 kills 6, then dies to 6; 6 died before
    assert {p: (r["armed"], r["again"], r["one"], r["two"], r["hurts"]) for p, r in got.items()} == {1: (False, 1, 1, 1, 1), 6: (True, 1, 1, 1, 0), 2: (False, 0, 0, 0, 0), 7: (False, 0, 0, 0, 0)}
    assert {r["player"]: (r["any"], r["two"]) for r in report.tables["t"].collect()}[1] == (True, 1)
    assert {r["player"]: r["any.count"] for r in report.tables["scoreboard_game"].collect()}[1] == 1
    assert {(r["highlight"], r["player"], r["tick"]) for r in report.tables["e"].collect()} == {(h, p, t) for h in ("any", "fresh") for p, t in ((1, 7), (6, 13))}


def test_queries_of_the_log(phases, spark):
    log, players = phases
    found = outputs.matching(log, "event.Attacker > 0 and round.enemies.alive >= 1", MATCH, "Attacker").collect()
    assert [r["seq"] for r in found] == [7, 13, 16]
    assert [r["seq"] for r in outputs.matching(log, "round.bomb.status == 'Planted'", MATCH, edges=True).collect()] == [8]
    with pytest.raises(RuleError):
        outputs.matching(log, "event.Attacker + 1", MATCH)
    more = roster(log, players.where("player <> 7")).collect()
    assert sorted((r["player"], r["team"]) for r in more) == [(1, 2), (2, 2), (6, 3), (7, None)]


def test_broken_rulesets_are_left_out(phases):
    log, players = phases
    docs = """
ruleset: bad
exports: [a]
stats: {a: {count: kil}, b: {count: kill, where: victim.helth > 3}, c: {count: kill, match: {weapn: x}}}
---
ruleset: above
use: [bad]
stats: {a: {count: kill}}
---
ruleset: good
stats: {a: {count: kill}, b: {sum: event.DmgHealth, on: damage_dealt}, d: {count: b}}
---
ruleset: fine
stats: {a: {count: kill}}
"""
    planner = Planner(log, players, MATCH)
    assert list(planner.run(model.read(docs), strict=False)) == ["fine"]
    said = {k: " ".join(map(str, v)) for k, v in planner.excluded.items()}
    assert all(x in said["bad"] for x in ("did you mean 'kill'?", "did you mean 'victim.health'?", "did you mean 'weapon'?"))
    assert "left out" in said["above"] and "rising edges" in said["good"]
    with pytest.raises(RuleError):
        Planner(log, players, MATCH).run(model.read(docs))
    with pytest.raises(RuleError):
        model.read("ruleset: x\nstats: {a: {count: kill, actor: other}}")
