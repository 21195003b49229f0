"""Tables beside rulesets: rounds on both clocks, a match's summary, clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import scalar
from matchloom.lang import expr
from matchloom.lang.diagnostics import Diagnostic, RuleError
from matchloom.operators import ranking, runs
from matchloom.operators.enrich import ENDS
from matchloom.rules.catalog import Catalog


def rounds(log: DataFrame, clock: str = "tick") -> DataFrame:
    """match_id, round_number, start, end, winner_side of an enriched log; ``clock``: the tick column to tell time by.

    A round without an end mark lasts until the match's last event.
    """
    last = F.max(clock).over(Window.partitionBy("match_id"))
    own = log.withColumn("_last", last).where("round_number > 0")
    over = F.col("event").isin(ENDS)
    return own.groupBy("match_id", "round_number").agg(
        F.min(clock).alias("start"),
        F.coalesce(F.min(F.when(over, F.col(clock))), F.max("_last")).alias("end"),
        F.max_by("round_winner_side", F.when(over, -F.col("seq"))).alias("winner_side"),
    )


def documents(game: DataFrame, names: dict[str, str], by: str = "match_id", player: str = "player") -> DataFrame:
    """One JSON document for each match: players and their stats under the names of ``names``."""
    own = F.struct(F.col(player).cast("string").alias("player"), *[F.col(f"`{c}`").cast("double").alias(n) for c, n in names.items()])
    return game.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(own)), {"ignoreNullFields": "false"}).alias("players"))


def clips(moments: DataFrame, rounds_: DataFrame, players: DataFrame, rate: float, lead: float = 5.0, tail: float = 3.0, first: Column | None = None) -> DataFrame:
    """Clips of highlight moments: hidden ones and those that a better one of their group supersedes go, windows stay
    inside their round, and windows of one player and round that touch become one with all titles.

    A player who is not on the roster has an empty name.
    """
    shown = ranking.supersede(moments.where("kind <> 'hidden'"), ["match_id", "player", "round_number"], "group", "score")
    placed = shown.join(rounds_.select("match_id", "round_number", F.col("start").alias("_rs"), F.col("end").alias("_re")), ["match_id", "round_number"])
    start, end = ranking.clip_window(F.col("tick"), F.col("tick") if first is None else first, F.col("_rs"), F.col("_re"), lead, tail, rate)
    windows = placed.select("match_id", "player", "round_number", "seq", start.alias("start"), end.alias("end"), "title")
    merged = ranking.coalesce_intervals(windows, ["match_id", "player", "round_number"], "start", "end", "title", ["seq"])
    roster = players.select("match_id", "player", F.col("player_name"))
    named = merged.join(roster, ["match_id", "player"], "left").withColumn("player_name", F.coalesce("player_name", F.lit("")))
    return named.orderBy(F.lower("match_id"), "start")


def matching(log: DataFrame, text: str, catalog: Catalog, actor: str | None = None, edges: bool = False, rate: float = 64.0) -> DataFrame:
    """match_id, seq, tick of the events for which an expression holds, or with ``edges`` for which it turns true.

    ``actor``: the column that names the player that ``player.`` names are of.
    """
    node = expr.parse(text, rate)
    types = lambda n: catalog.event.get(n[6:]) if n.startswith("event.") else catalog.names.get(n, (None,))[0]
    if (kind := expr.check(node, types)) not in ("bool", "null"):
        raise RuleError(Diagnostic("E_TYPE", f"is {kind}, not bool"))
    of = lambda n: F.col(n[6:]) if n.startswith("event.") else F.col(catalog.names[n][1].format(actor=actor or "player"))
    when = scalar.truth(expr.column(node, of, types))
    found = runs.rising(log, ["match_id"], ["seq"], when).where("edge") if edges else log.where(when)
    return found.select("match_id", "seq", "tick").orderBy("match_id", "seq")
