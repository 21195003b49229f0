"""Rulesets as DataFrames.

The planner groups stats by scope.  For each scope - per player and round, per
player, or per match - all counts, sums, captures, flags and tallies are
conditional aggregates of one groupBy over the event log, in which an event has
one row for each player column that a stat of the scope is bound to.  Formulas
are a projection on top.  Streaks, bursts and highlight moments are window
functions over the same partitioning; buckets are groupBys on their key.
Players without events get their row from the spine.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import scalar
from matchloom.lang import expr
from matchloom.lang.diagnostics import Diagnostic, RuleError
from matchloom.lang.expr import Node
from matchloom.operators import runs, stats
from matchloom.rules.catalog import Catalog, View
from matchloom.rules.model import DEFAULT_RUN, DEFAULT_WINDOW, Ruleset, Stat, Trigger, ordered

MATCH, PLAYER, ROUND = "match_id", "player", "round_number"


@dataclass
class Report:
    """Tables of one ruleset: by match and player, by round too, keyed buckets, highlight moments, and those it asks to show."""

    game: DataFrame
    rounds: DataFrame
    keyed: dict[str, DataFrame] = field(default_factory=dict)
    moments: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)


class Planner:
    """Plans rulesets against an event log.

    ``log``: match_id, seq, tick, event, round_number and the columns that the catalog names.
    ``players``: match_id, player, and any further columns, which go to the tables.
    ``player_rounds``: match_id, player, round_number and what is known of a player in a round, if anything.
    """

    def __init__(self, log: DataFrame, players: DataFrame, catalog: Catalog, tick_rate: float = 64.0, player_rounds: DataFrame | None = None):
        self.log, self.players, self.catalog, self.rate = log, players, catalog, tick_rate
        self.player_rounds = player_rounds
        self.done: dict[str, tuple[Ruleset, Report]] = {}
        #: Rulesets that were left out, with the reasons.
        self.excluded: dict[str, list[Diagnostic]] = {}

    def run(self, rulesets: list[Ruleset], strict: bool = True) -> dict[str, Report]:
        """Reports of all rulesets, used ones first; every ruleset is checked before any is planned.

        A ruleset with faults is an error; without ``strict`` it is left out, with those that use it, and the others run.
        """
        rulesets = ordered(rulesets)
        by = {x.id: x for x in rulesets}
        for r in rulesets:
            found = check(r, self.catalog, by, self.rate)
            found += [Diagnostic("R_REF", f"uses {u!r}, which is left out", where=r.id) for u in r.use if u in self.excluded]
            if found:
                self.excluded[r.id] = found
        if self.excluded and strict:
            raise RuleError(*[d for found in self.excluded.values() for d in found])
        rulesets = [r for r in rulesets if r.id not in self.excluded]
        for r in rulesets:
            self.done[r.id] = (r, _Plan(self, r).report())
        return {k: v[1] for k, v in self.done.items()}


def _hint(name: str, known: Iterable[str]) -> str:
    near = difflib.get_close_matches(name, list(known), 1)
    return f"; did you mean {near[0]!r}?" if near else ""


def _names(r: Ruleset, catalog: Catalog) -> list[str]:
    """Names that expressions of a ruleset may use."""
    own = [*r.stats, *r.highlights, *r.defines, *(f"params.{p}" for p in r.params)]
    return [*own, *catalog.names, *(f"event.{e}" for e in catalog.event), "player.slot", "player.name"]


def _counted(r: Ruleset, s: Stat) -> Stat | None:
    """The flag that a count counts the rising edges of, if it does."""
    return r.stats.get(s.trigger.on) if s.kind == "count" and s.trigger is not None else None


def _off(s: Stat) -> Stat | None:
    """What turns a flag off, as a stat: ``off:`` names a view, or is a trigger."""
    off = s.options.get("off")
    if s.kind != "flag" or s.trigger is None or off is None:
        return None
    body = off if isinstance(off, Mapping) else {"on": off}
    return Stat(f"{s.id}~off", "flag", s.per, Trigger(str(body.get("on")), body.get("match") or {}, body.get("where"), body.get("while"), body.get("actor") == "any"))


def _types(r: Ruleset, catalog: Catalog, others: Mapping[str, Ruleset]) -> Callable[[str], str | None]:
    kinds = {"compute": "float", "flag": "bool", "rate": "float"}
    targets = {t["target"] for s in r.stats.values() if s.kind == "tally" for t in s.options["thresholds"]}

    def of(name: str) -> str | None:
        if name.startswith("event."):
            return catalog.event.get(name[6:])
        if name.startswith("params."):
            value = r.params.get(name[7:])
            return None if value is None else expr._of(value)
        if name in catalog.names:
            return catalog.names[name][0]
        if name in ("player.slot", "player.name"):
            return "int" if name == "player.slot" else "string"
        head, _, tail = name.partition(".")
        if name in r.stats:
            return "list" if r.stats[name].options.get("keep") == "list" else kinds.get(r.stats[name].kind, "float")
        if name in targets:
            return "float"
        if head in r.highlights:
            return "bool" if not tail else "float" if tail == "count" else None
        if head in r.stats and tail == "set":
            return "bool"
        if head in r.use and head in others and tail:
            return _types(others[head], catalog, others)(tail) if tail.partition(".")[0] in others[head].exports else None
        return None

    return of


def _inline(r: Ruleset, node: Node) -> Node:
    """Parameters as literals and macro definitions as their trees."""

    def known(name: str) -> Node | None:
        if name.startswith("params.") and name[7:] in r.params:
            return Node("literal", r.params[name[7:]])
        d = r.defines.get(name)
        if isinstance(d, list):
            return Node("list", None, tuple(Node("literal", x) for x in d))
        return expr.parse(d) if isinstance(d, (str, int, float)) and not isinstance(d, bool) else None

    return expr.substitute(node, known)


def condition(r: Ruleset, t: Trigger, view: View, rate: float) -> Node | None:
    """The whole condition of a trigger: what the view bakes in, its facets, and free conditions."""
    parts = [expr.parse(view.baked)] if view.baked else []
    for name, test in t.match.items():
        if name == "actor":
            continue
        if name not in view.facets:
            raise RuleError(Diagnostic("R_REF", f"no facet {name!r}{_hint(name, view.facets)}"))
        facet = view.facets[name]
        if isinstance(test, str) and test[:1] in "<>=!":
            parts.append(expr.parse(f"{facet} {test}", rate))
        elif isinstance(test, str) and test.startswith("in "):
            parts.append(expr.parse(f"{facet} {test}", rate))
        elif isinstance(test, str) and ".." in test:
            low, high = test.split("..")
            parts += [expr.parse(f"{facet} >= {low}", rate), expr.parse(f"{facet} <= {high}", rate)]
        else:
            parts.append(Node("binary", "==", (expr.parse(facet), Node("literal", test))))
    for text in (t.where, t.gate):
        if text is not None:
            parts += expr.clauses(expr.parse(text, rate))
    whole = expr.joined(parts)
    return None if whole is None else _inline(r, whole)


def check(r: Ruleset, catalog: Catalog, others: Mapping[str, Ruleset], rate: float = 64.0) -> list[Diagnostic]:
    """What is wrong with a ruleset's references and types."""
    types, found = _types(r, catalog, others), []

    def tried(where: str, text: object, want: str | None = None) -> None:
        try:
            kind = expr.check(_inline(r, expr.parse(text, rate) if not isinstance(text, Node) else text), types)
            if want and kind not in (want, "null"):
                found.append(Diagnostic("E_TYPE", f"is {kind}, not {want}", where=f"{r.id}.{where}"))
        except RuleError as e:
            for d in e.found:
                unknown = re.match(r"unknown name '(.+)'$", d.message)
                found.append(Diagnostic(d.code, d.message + (_hint(unknown[1], _names(r, catalog)) if unknown else ""), d.at, f"{r.id}.{where}"))

    for s in [*r.stats.values(), *filter(None, map(_off, r.stats.values()))]:
        if (flag := _counted(r, s)) is not None:
            if flag.kind != "flag":
                found.append(Diagnostic("R_KIND", f"{flag.id!r} is a {flag.kind}; only the rising edges of a flag can be counted", where=f"{r.id}.{s.id}"))
            continue
        if s.trigger is not None:
            view = catalog.view(s.trigger.on)
            if view is None:
                found.append(Diagnostic("R_REF", f"no view {s.trigger.on!r}{_hint(s.trigger.on, [*catalog.views, *r.stats])}", where=f"{r.id}.{s.id}"))
                continue
            try:
                whole = condition(r, s.trigger, view, rate)
            except RuleError as e:
                found.extend(Diagnostic(d.code, d.message, d.at, f"{r.id}.{s.id}") for d in e.found)
                continue
            if whole is not None:
                tried(s.id, whole, "bool")
        if s.kind in ("sum", "capture", "compute") or s.kind == "flag" and s.value is not None:
            tried(s.id, s.value, "bool" if s.kind == "flag" else None)
        if s.kind == "tally" and s.value not in r.stats:
            found.append(Diagnostic("R_REF", f"no stat {s.value!r}{_hint(str(s.value), r.stats)}", where=f"{r.id}.{s.id}"))
    for h in r.highlights.values():
        tried(h.id, h.when, "bool")
    return found


class _Plan:
    def __init__(self, planner: Planner, r: Ruleset):
        self.p, self.r, self.catalog = planner, r, planner.catalog
        self.types = _types(r, planner.catalog, {k: v[0] for k, v in planner.done.items()})
        self.each = r.scope == "each_player"
        self.keys = [MATCH, PLAYER] if self.each else [MATCH]
        self.bound: dict[str, tuple[str | None, Column | None]] = {}
        self.off = {s.id: off for s in r.stats.values() if (off := _off(s)) is not None}
        #: Stats that look at events, and what turns flags off.
        self.stats = {s.id: s for s in (*r.stats.values(), *self.off.values()) if s.trigger is not None and _counted(r, s) is None}
        for s in self.stats.values():
            self.bound[s.id] = self._binding(s)

    def _column(self, node: Node, actor: str | None, siblings: bool = False) -> Column:
        def of(name: str) -> Column:
            if name.startswith("event."):
                return F.col(name[6:])
            if name == "player.slot":
                return F.col(PLAYER)
            if name in self.catalog.names and not (siblings and name == "round.number"):
                return F.col(self.catalog.names[name][1].format(actor=actor or PLAYER))
            if name.endswith(".set"):
                return F.col(name[:-4]).isNotNull()
            return F.col(f"`{name}`")

        return expr.column(_inline(self.r, node), of, self.types)

    def _binding(self, s: Stat) -> tuple[str | None, Column]:
        """Player column of a stat's events, and their condition."""
        view = self.catalog.view(s.trigger.on)
        actor = view.actor if self.each and not s.trigger.any_actor else None
        whole = condition(self.r, s.trigger, view, self.p.rate)
        parts = expr.clauses(whole) if whole is not None else []
        if self.each and actor is None:
            # ``x == player.slot`` among the conditions binds the player, without a cross join
            for k, c in enumerate(parts):
                if c.kind == "binary" and c.value == "==" and "player.slot" in (c.args[0].path, c.args[1].path):
                    other = c.args[0] if c.args[1].path == "player.slot" else c.args[1]
                    name = other.path or ""
                    actor = name[6:] if name.startswith("event.") else self.catalog.names.get(name, (None, None))[1]
                    del parts[k]
                    break
        when = F.col("event").isin(list(view.events))
        if parts:
            when = when & self._column(expr.joined(parts), actor)
        return actor, when

    def _rows(self, ids: list[str]) -> DataFrame:
        """The log with a row for each event and player that one of the stats concerns; ``_role``: the column that named the player."""
        log = self.p.log
        ids = [*ids, *[self.off[s].id for s in ids if s in self.off]]
        names = {n for s in ids for n in self.catalog.view(self.stats[s].trigger.on).events}
        log = log.where(F.col("event").isin(sorted(names)))
        if not self.each:
            return log.withColumn("_role", F.lit(None).cast("string"))
        roles = sorted({self.bound[s][0] for s in ids} - {None})
        out = []
        if roles:
            who = F.array(*[F.struct(F.lit(c).alias("_role"), F.col(c).cast("long").alias(PLAYER)) for c in roles])
            out.append(log.select("*", F.inline(F.filter(who, lambda x: x[PLAYER].between(0, (1 << 62))))))
        if any(self.bound[s][0] is None for s in ids):
            # events without an actor concern every player of their match
            out.append(log.join(self.p.players.select(MATCH, F.col(PLAYER).cast("long").alias(PLAYER)), MATCH).withColumn("_role", F.lit("*")))
        rows = out[0]
        for x in out[1:]:
            rows = rows.unionByName(x)
        return rows

    def _when(self, s: Stat) -> Column:
        actor, when = self.bound[s.id]
        return when if not self.each else when & (F.col("_role") == (actor or "*"))

    def _state(self, s: Stat) -> Column:
        """What an event makes of a flag: true, false, or null if it leaves it as it is."""
        on = F.when(scalar.truth(self._when(s)), F.lit(True))
        return on.when(scalar.truth(self._when(self.off[s.id])), F.lit(False)) if s.id in self.off else on

    def _same(self, s: Stat) -> str:
        """What a stat's aggregate is made of, but for its name."""
        condition_ = condition(self.r, s.trigger, self.catalog.view(s.trigger.on), self.p.rate)
        value = _inline(self.r, expr.parse(s.value, self.p.rate)) if s.kind in ("sum", "capture") else None
        return expr.identity(s.kind, s.trigger.on, self.bound[s.id][0], condition_, value, s.options.get("keep"), repr(self.off.get(s.id)))

    def _aggregate(self, s: Stat) -> Column:
        when, order = self._when(s), F.col("seq")
        if s.id in self.off:
            state = self._state(s)
            return F.max_by(state, F.when(state.isNotNull(), order)).alias(s.id)
        value = self._column(expr.parse(s.value, self.p.rate), self.bound[s.id][0]) if s.kind in ("sum", "capture") else None
        keep = s.options.get("keep", "last")
        return {
            "count": lambda: stats.count(when),
            "sum": lambda: stats.total(value, when),
            "flag": lambda: stats.flag(when),
            "capture": lambda: {
                "first": lambda: stats.first(value, order, when),
                "last": lambda: stats.last(value, order, when),
                "list": lambda: stats.listed(value, order, when),
                "min": lambda: stats.smallest(value, when),
                "max": lambda: stats.largest(value, when),
            }[keep](),
        }[s.kind]().alias(s.id)

    def _grouped(self, keys: list[str], per: str, extra: set[str] = frozenset()) -> DataFrame | None:
        own = [s for s in self.r.stats.values() if s.kind in ("count", "sum", "capture", "flag") and s.id in self.stats and (s.per == per or s.id in extra)]
        if not own:
            return None
        # stats that are the same are one aggregate
        first: dict[str, Stat] = {}
        same = {s.id: first.setdefault(self._same(s), s).id for s in own}
        found = self._rows([s.id for s in first.values()]).groupBy(*keys).agg(*map(self._aggregate, first.values()))
        return found.withColumns({k: F.col(f"`{v}`") for k, v in same.items() if k != v}) if len(first) < len(own) else found

    def _edges(self, s: Stat, by_round: DataFrame) -> DataFrame:
        """How often the flag that ``s`` counts turned true, by the keys of the scope, and by round if it is per round."""
        flag = _counted(self.r, s)
        keys = [*self.keys, ROUND] if s.per == "round" else self.keys
        if flag.id not in self.stats:
            return by_round.groupBy(*keys).agg(F.count_if(F.col(f"`{flag.id}`")).alias(s.id))
        own = [*self.keys, ROUND] if flag.per == "round" else self.keys
        w = Window.partitionBy(*own).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        # an event that concerns a player in several roles is one step
        rows = self._rows([flag.id]).withColumn("_state", self._state(flag)).where(F.col("_state").isNotNull())
        rows = rows.groupBy(*self.keys, ROUND, "seq").agg(F.bool_or("_state").alias("_state"))
        held = rows.withColumn("_held", F.last("_state", ignorenulls=True).over(w))
        return runs.rising(held, own, ["seq"], F.col("_held")).groupBy(*keys).agg(F.count_if("edge").alias(s.id))

    def _zeros(self, table: DataFrame) -> DataFrame:
        fill = {}
        for s in self.r.stats.values():
            if s.id in table.columns and s.kind in ("count", "sum", "streak", "burst"):
                fill[s.id] = F.coalesce(F.col(f"`{s.id}`"), F.lit(0))
            elif s.id in table.columns and s.kind == "flag":
                fill[s.id] = scalar.truth(F.col(f"`{s.id}`"))
        return table.withColumns(fill) if fill else table

    def report(self) -> Report:
        r, log = self.r, self.p.log
        rounds = log.where(F.col(ROUND) >= 1).groupBy(MATCH, ROUND).agg(F.max("seq").alias("_end"))
        base = self.p.players if self.each else self.p.players.select(MATCH).distinct()
        by_round = base.join(rounds.drop("_end"), MATCH)
        tallied = {s.value for s in r.stats.values() if s.kind == "tally"}
        found = self._grouped([*self.keys, ROUND], "round", tallied)
        if found is not None:
            by_round = by_round.join(found, [*self.keys, ROUND], "left")
        by_round = self._zeros(by_round)
        counted = [s for s in r.stats.values() if _counted(r, s) is not None]
        for s in counted:
            if s.per == "round":
                by_round = by_round.join(self._edges(s, by_round), [*self.keys, ROUND], "left").withColumn(s.id, F.coalesce(F.col(f"`{s.id}`"), F.lit(0)))
        if self.each and self.p.player_rounds is not None:
            by_round = by_round.join(self.p.player_rounds, [*self.keys, ROUND], "left")
        for s in r.stats.values():
            if s.per == "round" and (s.kind == "compute" or s.kind == "flag" and s.value is not None):
                by_round = by_round.withColumn(s.id, self._formula(s, by_round))
        game = base.join(rounds.groupBy(MATCH).agg(F.max(ROUND).alias(ROUND)), MATCH, "left")
        found = self._grouped(self.keys, "match")
        if found is not None:
            game = game.join(found, self.keys, "left")
        for s in r.stats.values():
            if s.kind in ("streak", "burst"):
                game = game.join(self._runs(s), self.keys, "left")
            elif s.kind == "tally":
                steps = {t["target"]: t["min"] for t in s.options["thresholds"]}
                game = game.join(stats.tally(by_round.withColumn("_v", F.col(f"`{s.value}`")), self.keys, "_v", steps), self.keys, "left")
                game = game.withColumns({t: F.coalesce(F.col(t), F.lit(0)) for t in steps})
        for s in counted:
            if s.per == "match":
                game = game.join(self._edges(s, by_round), self.keys, "left")
        game = self._zeros(game)
        moments = self._moments(by_round)
        for h in r.highlights.values():
            if h.per == "round" or self._per_round(h.when):
                when = self._column(expr.parse(h.when, self.p.rate), None, siblings=True)
                by_round = by_round.withColumn(h.id, scalar.truth(when))
                fired = by_round.groupBy(*self.keys).agg(F.count_if(F.col(h.id)).alias(f"{h.id}.count"), F.bool_or(F.col(h.id)).alias(h.id))
                game = game.join(fired, self.keys, "left")
        for u in r.use:
            other = self.p.done[u]
            taken = [c for c in other[1].game.columns if c.partition(".")[0] in other[0].exports]
            game = game.join(other[1].game.select(*self.keys, *[F.col(f"`{c}`").alias(f"{u}.{c}") for c in taken]), self.keys, "left")
        for s in r.stats.values():
            if s.per == "match" and (s.kind == "compute" or s.kind == "flag" and s.value is not None):
                game = game.withColumn(s.id, self._formula(s, game))
        for h in r.highlights.values():
            if h.per == "match" and h.id not in game.columns:
                game = game.withColumn(h.id, scalar.truth(self._column(expr.parse(h.when, self.p.rate), None, siblings=True))).withColumn(f"{h.id}.count", F.col(f"`{h.id}`").cast("long"))
        for s in r.stats.values():
            if s.kind == "compute" and (digits := {"F0": 0, "F1": 1, "F2": 2}.get(s.format or "F1")) is not None:
                game, by_round = (t.withColumn(s.id, scalar.rounded(F.col(f"`{s.id}`"), digits)) if s.id in t.columns else t for t in (game, by_round))
        report = Report(game, by_round, {s.id: self._bucket(s) for s in r.stats.values() if s.kind == "bucket"}, moments)
        for s in r.stats.values():
            if s.kind == "rate":
                of = s.options
                report.keyed[s.id] = stats.rate(report.keyed[of["rate"] if isinstance(of["rate"], str) else of["of"]], report.keyed[of["of"]], [*self.keys, "key"])
        report.tables = self._shown(report)
        return report

    def _per_round(self, text: str) -> bool:
        names = {n.partition(".")[0] for n in expr.parse(text, self.p.rate).names() if not n.endswith(".count")}
        return any(n in self.r.stats and self.r.stats[n].per == "round" for n in names)

    def _formula(self, s: Stat, table: DataFrame) -> Column:
        node = expr.parse(s.value, self.p.rate)
        missing = {n for n in _inline(self.r, node).names() if n in self.catalog.names and self.catalog.names[n][1].format(actor=PLAYER) not in table.columns}
        if missing:
            raise RuleError(Diagnostic("R_SCOPE", f"{sorted(missing)[0]!r} cannot be read here", where=f"{self.r.id}.{s.id}"))
        return self._column(node, None)

    def _runs(self, s: Stat) -> DataFrame:
        rows = self._rows([s.id]).where(self._when(s))
        window = s.options.get("window", DEFAULT_WINDOW)
        ticks = expr.parse(str(window), self.p.rate).value if isinstance(window, str) else window
        least = int(s.options.get("min_streak", DEFAULT_RUN))
        if s.kind == "streak":
            return runs.streaks(rows, self.keys, ["seq"], "tick", ticks, least, ROUND if s.per == "round" else None, s.id)
        return runs.bursts(rows, self.keys, ["seq"], "tick", ticks, least).groupBy(*self.keys).agg(F.count_if("pulse").alias(s.id))

    def _bucket(self, s: Stat) -> DataFrame:
        actor = self.bound[s.id][0]
        keys = s.options["key"] if isinstance(s.options["key"], list) else [s.options["key"]]
        value = s.options.get("value")
        rows = self._rows([s.id]).where(self._when(s))
        of = lambda text: self._column(expr.parse(text, self.p.rate), actor)
        return stats.bucket(rows, self.keys, [of(k) for k in keys], s.options.get("reduce", "sum" if value is not None else "count"), None if value is None else of(value))

    def _moments(self, by_round: DataFrame) -> DataFrame | None:
        """A row for each time that a highlight over counts of its round turns true: the event that made it so."""
        out = []
        for h in self.r.highlights.values():
            node = _inline(self.r, expr.parse(h.when, self.p.rate))
            names = sorted(node.names())
            if not names or any(n not in self.r.stats or self.r.stats[n].per != "round" or self.r.stats[n].kind not in ("count", "sum", "flag") or self.r.stats[n].trigger is None for n in names):
                continue
            w = Window.partitionBy(*self.keys, ROUND).orderBy("seq", "_role").rowsBetween(Window.unboundedPreceding, 0)
            rows = self._rows(names)
            running = rows.withColumns({n: self._running(self.r.stats[n], w) for n in names})
            # an event that concerns a player in several roles is one step, after all of them
            running = running.withColumn("_more", F.lead("seq").over(Window.partitionBy(*self.keys, ROUND, "seq").orderBy("_role"))).where("_more is null").drop("_more")
            fired = runs.rising(running, [*self.keys, ROUND], ["seq"], self._column(node, None, siblings=True)).where("edge")
            out.append(fired.select(F.lit(h.id).alias("highlight"), *self.keys, ROUND, "seq", "tick", F.lit(h.score).alias("score"), F.lit(h.kind).alias("kind"), F.lit(h.group).cast("string").alias("group"), scalar.title(h.title, {"round.number": F.col(ROUND), "player.slot": F.col(PLAYER) if self.each else F.lit(None), **{n: F.col(n) for n in names}}).alias("title")))
        if not out:
            return None
        rows = out[0]
        for x in out[1:]:
            rows = rows.unionByName(x)
        return rows

    def _running(self, s: Stat, w) -> Column:
        when = self._when(s)
        if s.kind == "count":
            return F.count_if(when).over(w)
        if s.id in self.off:
            return scalar.truth(F.last(self._state(s), ignorenulls=True).over(w))
        if s.kind == "flag":
            return F.bool_or(scalar.truth(when)).over(w)
        return F.coalesce(F.sum(F.when(when, self._column(expr.parse(s.value, self.p.rate), self.bound[s.id][0]))).over(w), F.lit(0))

    def _shown(self, report: Report) -> dict[str, DataFrame]:
        """Tables and scoreboards that the ruleset asks for, with their labels; lists become a count and columns."""
        out = {}
        show = self.r.show
        wanted = {name: (t.get("per", "player_match"), t["columns"]) for name, t in (show.get("tables") or {}).items()}
        boards = {"scoreboard_game", "scoreboard_round"}
        board = show.get("scoreboard") or []
        own = lambda e: self.r.stats.get(e["stat"].partition(".")[0]) or self.r.highlights.get(e["stat"].partition(".")[0])
        for per, name in (("match", "scoreboard_game"), ("round", "scoreboard_round")):
            mine = [e for e in board if (e.get("group") == "round") == (per == "round") and e["stat"] in [*report.game.columns, *report.rounds.columns] or own(e) is None and per == "match"]
            if mine:
                wanted[name] = ("player_round" if per == "round" else "player_match", mine)
        for name, (per, columns) in wanted.items():
            if per == "event":
                # a row for each moment, with what is asked for of it
                if report.moments is not None:
                    picked = [F.col(c["stat"]).alias(c.get("label") or c["stat"]) for c in columns if c["stat"] in report.moments.columns]
                    out[name] = report.moments.select(*self.keys, ROUND, "seq", *[p for p in picked])
                continue
            source = report.rounds if per.endswith("round") else report.game
            keys = [c for c in (*self.p.players.columns, ROUND) if c in source.columns and (c != ROUND or per.endswith("round"))]
            picked = []
            for c in columns:
                stat = c["stat"]
                # boards show how often, tables whether
                if name in boards and per.endswith("match") and stat in self.r.highlights:
                    stat = f"{stat}.count"
                if stat not in source.columns:
                    continue
                value, label = F.col(f"`{stat}`"), c.get("label") or stat
                base = self.r.stats.get(stat)
                if base is not None and base.options.get("keep") == "list":
                    picked.append(F.coalesce(F.size(value), F.lit(0)).alias(f"{label}Count"))
                    picked += [F.get(value, F.lit(k)).alias(f"{label}{k + 1}") for k in range(int(c.get("most", 5)))]
                elif c.get("as") == "seconds":
                    picked.append(scalar.seconds(value, self.p.rate).alias(label))
                elif c.get("as") == "time":
                    picked.append(scalar.clock(value, self.p.rate).alias(label))
                else:
                    picked.append(value.alias(label))
            out[name] = source.select(*[F.col(k) for k in keys], *picked)
        return out
