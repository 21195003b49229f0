"""Vocabulary that rulesets are written in: views over events, their actors and facets, and what names mean."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class View:
    """Events of some names; ``actor``: the column that holds the player; ``baked``: a condition that is part of the view."""

    events: tuple[str, ...]
    actor: str | None = None
    baked: str | None = None
    facets: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Catalog:
    """``event``: types of payload columns; ``names``: types of other dotted names and the columns behind them
    ({actor} in a column stands for the view's actor); ``end``: views that end a round."""

    views: Mapping[str, View]
    event: Mapping[str, str]
    names: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    end: str | None = None

    def view(self, name: str) -> View | None:
        return View((name[4:],)) if name.startswith("raw.") else self.views.get(name)


_V = View
_NE = "event.Attacker != event.UserId"
# Views, facets and columns of match logs.
MATCH = Catalog(
    views={
        "kill": _V(("player_death",), "Attacker", _NE, {"enemy": "enrich.kill.was_enemy_kill", "teamkill": "enrich.kill.was_team_kill", "trade": "enrich.kill.was_trade_kill", "flash_assisted": "enrich.kill.was_flash_kill", "headshot": "event.Headshot", "through_smoke": "event.ThruSmoke", "no_scope": "event.NoScope", "weapon": "event.Weapon"}),
        "death": _V(("player_death",), "UserId", None, {"enemy": "enrich.kill.was_enemy_kill", "headshot": "event.Headshot", "attacker_blind": "event.AttackerBlind", "through_smoke": "event.ThruSmoke", "no_scope": "event.NoScope", "weapon": "event.Weapon"}),
        "assist": _V(("player_death",), "Assister", _NE, {"flash": "event.AssistedFlash", "enemy": "enrich.kill.was_enemy_assist", "weapon": "event.Weapon"}),
        "damage_dealt": _V(("player_hurt",), "Attacker", None, {"enemy": "enrich.hurt.was_enemy_damage", "teamdamage": "enrich.hurt.was_team_damage", "bullet": "enrich.hurt.is_bullet", "capped": "enrich.hurt.capped_damage", "amount": "event.DmgHealth", "hitgroup": "event.HitGroup", "weapon": "event.Weapon"}),
        "damage_taken": _V(("player_hurt",), "UserId", None, {"enemy": "enrich.hurt.was_enemy_damage", "bullet": "enrich.hurt.is_bullet", "amount": "event.DmgHealth", "hitgroup": "event.HitGroup", "weapon": "event.Weapon"}),
        "shot": _V(("weapon_fire",), "UserId", None, {"weapon": "event.Weapon", "silenced": "event.Silenced", "bullet": "enrich.weapon_fire.is_bullet"}),
        "shot_landed": _V(("bullet_damage",), "Attacker", None, {"in_air": "event.InAir", "no_scope": "event.NoScope", "distance": "event.Distance", "recoil_index": "event.RecoilIndex", "turn_degrees": "enrich.shot.turn_degrees", "ticks_since_last_shot": "enrich.shot.ticks_since_last_shot", "spray_shots": "enrich.shot.spray_shots", "spray_victims": "enrich.shot.spray_victims"}),
        "blinded": _V(("player_blind",), "UserId", None, {"enemy": "enrich.blind.was_enemy_flash", "duration": "enrich.blind.duration"}),
        "blinded_enemy": _V(("player_blind",), "Attacker", None, {"enemy": "enrich.blind.was_enemy_flash", "duration": "enrich.blind.duration"}),
        "he_grenade": _V(("hegrenade_detonate",), "UserId"),
        "flash_grenade": _V(("flashbang_detonate",), "UserId"),
        "smoke_grenade": _V(("smokegrenade_detonate",), "UserId"),
        "molotov": _V(("molotov_thrown",), "PlayerSlot"),
        "bomb_planted": _V(("bomb_planted",), None, None, {"site": "event.Site"}),
        "bomb_defused": _V(("bomb_defused",), None, None, {"site": "event.Site"}),
        "round_won": _V(("round_officially_ended", "cs_win_panel_match"), None, None, {"winner_team": "enrich.round.winner_team", "winner_side": "enrich.round.winner_side", "has_winner": "enrich.round.has_winner"}),
        "round_lost": _V(("round_officially_ended", "cs_win_panel_match"), None, None, {"winner_team": "enrich.round.winner_team", "winner_side": "enrich.round.winner_side", "has_winner": "enrich.round.has_winner"}),
    },
    event={
        **dict.fromkeys(("UserId", "Attacker", "Assister", "DmgHealth", "DmgArmor", "HitGroup", "Penetrated", "Revenge", "Dominated", "Health", "Team", "OldTeam", "Site", "PlayerSlot", "Victim"), "int"),
        **dict.fromkeys(("Headshot", "ThruSmoke", "NoScope", "AttackerBlind", "AssistedFlash", "AttackerInAir", "Silenced", "InAir"), "bool"),
        **dict.fromkeys(("Distance", "BlindDuration", "ShootAngX", "ShootAngY", "RecoilIndex"), "float"),
        "Weapon": "string",
        "tick": "instant",
    },
    names={
        **{f"enrich.kill.{n}": ("bool", f"kill_{n}") for n in ("was_self_kill", "was_team_kill", "was_enemy_kill", "was_enemy_assist", "was_trade_kill", "was_flash_kill", "clutch_detected")},
        **{f"enrich.kill.{n}": ("int", f"kill_{n}") for n in ("traded_player_slot", "flash_attacker_slot", "spray_kills", "spray_shots_at_kill")},
        **{f"enrich.hurt.{n}": ("bool", f"hurt_{n}") for n in ("was_enemy_damage", "was_team_damage", "was_self_damage", "is_bullet")},
        **{f"enrich.hurt.{n}": ("int", f"hurt_{n}") for n in ("victim_health_before", "capped_damage")},
        "enrich.blind.was_enemy_flash": ("bool", "blind_was_enemy_flash"),
        "enrich.blind.duration": ("float", "blind_duration"),
        "enrich.round.has_winner": ("bool", "round_has_winner"),
        "enrich.round.winner_team": ("int", "round_winner_side"),
        "enrich.round.winner_side": ("int", "round_winner_side"),
        "enrich.clutch.was_clutch_won": ("bool", "clutch_won"),
        "enrich.clutch.winner_slot": ("int", "clutch_winner_slot"),
        "enrich.weapon_fire.is_bullet": ("bool", "shot_is_bullet"),
        "enrich.shot.turn_degrees": ("float", "shot_turn_degrees"),
        "enrich.shot.ticks_since_last_shot": ("int", "shot_ticks_since_last_shot"),
        "enrich.shot.spray_shots": ("int", "shot_spray_shots"),
        "enrich.shot.spray_victims": ("int", "shot_spray_victims"),
        "round.number": ("int", "round_number"),
        "round.active": ("bool", "round_active"),
        "round.no_deaths_yet": ("bool", "no_deaths_yet"),
        "round.bomb.was_planted": ("bool", "bomb_was_planted"),
        "round.gameplay_phase": ("string", "gameplay_phase"),
        "round.bomb.status": ("string", "bomb_status"),
        "round.after_half_announce": ("int", "rounds_after_half_announce"),
        "round.team.alive": ("int", "{actor}_team_alive"),
        "round.team.players": ("int", "{actor}_team_players"),
        "round.team.equipment": ("int", "{actor}_team_equipment"),
        "round.enemies.alive": ("int", "{actor}_enemies_alive"),
        "round.enemies.players": ("int", "{actor}_enemies_players"),
        "round.enemies.equipment": ("int", "{actor}_enemies_equipment"),
        "round.alive.in_clutch": ("bool", "{actor}_in_clutch"),
        "round.clutch.size": ("int", "{actor}_clutch_size"),
        "match.half_state": ("string", "half_state"),
        "match.regulation_status": ("string", "regulation_status"),
        "match.live": ("bool", "match_live"),
        "match.map": ("string", "map_name"),
        "player.team": ("int", "{actor}_team"),
        "player.alive": ("bool", "{actor}_alive"),
        "player.survived": ("bool", "{actor}_survived"),
        "player.traded": ("bool", "{actor}_traded"),
        "enrich.hurt.attacker_active_weapon": ("string", "Attacker_active_weapon"),
        **{
            f"{role}.{name}": (kind, f"{column}_{what}")
            for role, column in (("player", "{actor}"), ("killer", "Attacker"), ("attacker", "Attacker"), ("victim", "UserId"), ("assister", "Assister"))
            for name, kind, what in (
                ("team", "int", "team"), ("alive", "bool", "alive"), ("health", "int", "health"), ("armor", "int", "armor"), ("equipment_value", "int", "equipment"),
                ("active_weapon", "string", "active_weapon"), ("active_weapon_clip", "int", "active_weapon_clip"), ("place", "string", "place"), ("entity.place", "string", "place"),
            )
        },
    },
    end="round_won",
)

#: The event table: users act, a day is a round.
EVENTS = Catalog(
    views={n: _V((n,), "actor", None, {"large": "event.k >= 50", "k": "event.k", "amount": "event.value"}) for n in ("view", "click", "purchase", "signup", "error")},
    event={"k": "int", "value": "float", "tick": "instant", "actor": "int", "event": "string"},
    names={"round.number": ("int", "round_number"), "player.team": ("int", "side")},
)
