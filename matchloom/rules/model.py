"""Rulesets: YAML documents as data, checked before Spark sees anything."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from matchloom.lang.diagnostics import Diagnostic, RuleError

# Words of the document format.
KINDS = ("count", "sum", "capture", "compute", "tally", "flag", "streak", "burst", "bucket", "rate")
TRIGGERED = ("count", "sum", "capture", "flag", "streak", "burst", "bucket")
REDUCERS = ("sum", "count", "min", "max", "last", "first")
KEEP = ("first", "last", "list", "min", "max")
PARAM_TYPES = ("int", "float", "bool", "string", "duration")
FIELDS = {
    "ruleset": {"ruleset", "title", "summary", "for", "enabled", "use", "exports", "params", "define", "stats", "highlights", "show", "for_each", "catalog_version", "min_app_version"},
    "stat": {*KINDS, "on", "match", "actor", "where", "while", "per", "keep", "value", "key", "reduce", "of", "live", "thresholds", "window", "min_streak", "min", "label", "format", "description", "off", "as", "for_each", "template"},
    "highlight": {"when", "per", "title", "score", "kind", "group", "for_each"},
    "trigger": {"on", "match", "actor", "where", "while"},
}
DEFAULT_WINDOW, DEFAULT_RUN = 640, 2


@dataclass(frozen=True)
class Trigger:
    """Events that a stat looks at."""

    on: str
    match: Mapping[str, object] = field(default_factory=dict)
    where: str | None = None
    gate: str | None = None
    any_actor: bool = False


@dataclass(frozen=True)
class Stat:
    id: str
    kind: str
    per: str = "match"
    trigger: Trigger | None = None
    value: object = None
    options: Mapping[str, object] = field(default_factory=dict)
    label: str | None = None
    format: str | None = None


@dataclass(frozen=True)
class Highlight:
    id: str
    when: str
    per: str = "round"
    title: str = ""
    score: int = 50
    kind: str = "highlight"
    group: str | None = None


@dataclass(frozen=True)
class Ruleset:
    id: str
    scope: str = "each_player"
    title: str = ""
    summary: str = ""
    enabled: bool = True
    use: tuple[str, ...] = ()
    exports: tuple[str, ...] = ()
    params: Mapping[str, object] = field(default_factory=dict)
    defines: Mapping[str, object] = field(default_factory=dict)
    stats: Mapping[str, Stat] = field(default_factory=dict)
    highlights: Mapping[str, Highlight] = field(default_factory=dict)
    show: Mapping[str, object] = field(default_factory=dict)


def expanded(section: Mapping[str, Mapping]) -> dict[str, dict]:
    """Entries with ``for_each`` once for each combination of its lists, the last varying fastest; {name} holes are filled."""
    out: dict[str, dict] = {}
    for name, body in section.items():
        axes = body.get("for_each") if isinstance(body, Mapping) else None
        if not axes:
            out[name] = body
            continue
        rest = {k: v for k, v in body.items() if k != "for_each"}
        for combination in itertools.product(*axes.values()):
            hole = dict(zip(axes, combination, strict=True))
            fill = lambda x: _filled(x, hole)  # noqa: B023, E731
            if (own := fill(name)) in out:
                raise RuleError(Diagnostic("R_ID", f"{own!r} comes out twice", where=name))
            # a match: takes literals, not holes
            out[own] = {k: v if k == "match" else fill(v) for k, v in rest.items()}
    return out


def _filled(x: object, hole: Mapping[str, object]) -> object:
    if isinstance(x, str):
        return re.sub(r"\{(\w+)\}", lambda m: str(hole[m[1]]) if m[1] in hole else m[0], x)
    if isinstance(x, Mapping):
        return {_filled(k, hole): _filled(v, hole) for k, v in x.items()}
    return [_filled(v, hole) for v in x] if isinstance(x, list) else x


class _Reader:
    def __init__(self, doc: Mapping, where: str):
        self.doc, self.found, self.where = doc, [], where

    def fault(self, code: str, message: str, where: str = "") -> None:
        self.found.append(Diagnostic(code, message, where=f"{self.where}.{where}" if where else self.where))

    def fields(self, body: Mapping, kind: str, where: str) -> None:
        for k in body:
            if k not in FIELDS[kind]:
                self.fault("R_FIELD", f"unknown field {k!r}", where)

    def trigger(self, body: Mapping, on: object, defines: Mapping) -> Trigger:
        actor = body.get("actor") or (body.get("match") or {}).get("actor")
        if actor not in (None, "any"):
            self.fault("R_VALUE", "actor: is any, or left out")
        own = Trigger(str(on), body.get("match") or {}, body.get("where"), _gate(body.get("while")), actor == "any")
        base = defines.get(str(on))
        if isinstance(base, Mapping) and "on" in base:
            inner = self.trigger(base, base["on"], defines)
            both = lambda a, b: f"({a}) and ({b})" if a and b else a or b
            return Trigger(inner.on, {**inner.match, **own.match}, both(inner.where, own.where), both(inner.gate, own.gate), inner.any_actor or own.any_actor)
        return own

    def stat(self, name: str, body: Mapping, defines: Mapping) -> Stat | None:
        self.fields(body, "stat", name)
        kinds = [k for k in KINDS if k in body and not (k == "count" and "bucket" in body)]
        if len(kinds) != 1:
            self.fault("R_KIND", f"has {len(kinds)} kinds", name)
            return None
        kind, main, per = kinds[0], body[kinds[0]], body.get("per", "match")
        if per not in ("match", "round"):
            self.fault("R_VALUE", "per: is match or round", name)
        for option, kinds_ in (("keep", ("capture",)), ("thresholds", ("tally",)), ("window", ("streak", "burst")), ("min_streak", ("streak", "burst")), ("key", ("bucket",)), ("value", ("bucket",)), ("reduce", ("bucket",)), ("of", ("rate",))):
            if option in body and kind not in kinds_:
                self.fault("R_FIELD", f"{option}: goes with {' or '.join(kinds_)} only", name)
        if kind in ("bucket", "rate") and per != "match":
            self.fault("R_SCOPE", f"a {kind} is per match", name)
        on, value = body.get("on"), None
        if kind in ("count", "streak", "burst", "bucket"):
            on = main
        elif kind in ("sum", "capture", "compute", "tally"):
            value = main
        elif kind == "flag":
            if isinstance(main, Mapping):
                value = main.get("when")
            elif main is not True:
                self.fault("R_VALUE", "flag: is true or has when:", name)
        if kind == "capture" and body.get("keep", "last") not in KEEP:
            self.fault("R_VALUE", f"keep: is one of {', '.join(KEEP)}", name)
        if kind == "tally":
            steps = body.get("thresholds") or []
            if not steps or any(not isinstance(s, Mapping) or "min" not in s or "target" not in s for s in steps):
                self.fault("R_VALUE", "a tally needs thresholds with min and target", name)
                return None
        if kind == "burst" and int(body.get("min_streak", DEFAULT_RUN)) < 2:
            self.fault("R_VALUE", "a burst has two events at least", name)
        if kind == "streak" and int(body.get("min_streak", DEFAULT_RUN)) < 1:
            self.fault("R_VALUE", "a streak has one event at least", name)
        if kind == "bucket":
            reduce = body.get("reduce", "sum" if "value" in body else "count")
            if reduce not in REDUCERS:
                self.fault("R_VALUE", f"reduce: is one of {', '.join(REDUCERS)}", name)
            if not body.get("key"):
                self.fault("R_FIELD", "a bucket needs a key", name)
            if reduce == "count" and "value" in body or reduce != "count" and "value" not in body:
                self.fault("R_VALUE", "value: goes with every reducer but count", name)
        if kind == "rate" and not {"of", "rate"} <= set(body):
            self.fault("R_FIELD", "a rate needs of:", name)
        trigger = None
        if kind in TRIGGERED and not (kind == "flag" and value is not None):
            if on is None:
                self.fault("R_FIELD", "needs on:", name)
                return None
            trigger = self.trigger(body, on, defines)
        return Stat(name, kind, per, trigger, value, dict(body), body.get("label"), body.get("format"))

    def read(self) -> Ruleset:
        d = self.doc
        self.fields(d, "ruleset", "")
        if not d.get("ruleset"):
            self.fault("R_FIELD", "needs ruleset:")
        if d.get("for", "each_player") not in ("each_player", "match"):
            self.fault("R_VALUE", "for: is each_player or match")
        params = {}
        for name, p in (d.get("params") or {}).items():
            kind, value = p.get("type"), p.get("default")
            if kind not in PARAM_TYPES:
                self.fault("R_VALUE", f"type is one of {', '.join(PARAM_TYPES)}", f"params.{name}")
            elif kind in ("int", "float") and (isinstance(value, bool) or not isinstance(value, (int, float))):
                self.fault("R_VALUE", "default is no number", f"params.{name}")
            elif kind in ("int", "float") and not p.get("min", value) <= value <= p.get("max", value):
                self.fault("R_VALUE", "default is out of range", f"params.{name}")
            params[name] = value
        defines = d.get("define") or {}
        for name, x in defines.items():
            if isinstance(x, Mapping) and "on" not in x and len({type(v) for v in x.values()} - {int, float}) + bool({int, float} & {type(v) for v in x.values()}) > 1:
                self.fault("R_VALUE", "a map has values of one type", f"define.{name}")
        stats: dict[str, Stat] = {}
        highlights: dict[str, Highlight] = {}
        try:
            sections = expanded(d.get("stats") or {}), expanded(d.get("highlights") or {})
        except RuleError as e:
            self.found += e.found
            sections = {}, {}
        for name, body in sections[0].items():
            if s := self.stat(name, body, defines):
                stats[name] = s
        for name, body in sections[1].items():
            self.fields(body, "highlight", name)
            when = body.get("when")
            if when is None:
                self.fault("R_FIELD", "needs when:", name)
                continue
            if not 0 <= body.get("score", 50) <= 100:
                self.fault("R_VALUE", "score is 0 to 100", name)
            if body.get("title", "").count("{") != body.get("title", "").count("}"):
                self.fault("R_VALUE", "title has an open hole", name)
            when = " and ".join(f"({w})" for w in when) if isinstance(when, list) else str(when)
            highlights[name] = Highlight(name, when, body.get("per", "round"), body.get("title", ""), body.get("score", 50), body.get("kind", "highlight"), body.get("group"))
        targets = [t["target"] for s in stats.values() if s.kind == "tally" for t in s.options["thresholds"]]
        ids = [*params, *defines, *stats, *highlights, *targets]
        for name in {i for i in ids if ids.count(i) > 1}:
            self.fault("R_ID", f"{name!r} is taken", name)
        for name in d.get("exports") or []:
            if name not in stats and name not in highlights:
                self.fault("R_REF", f"exports {name!r}, which is none", "exports")
        if d.get("for") == "match" and (highlights or (d.get("show") or {}).get("scoreboard")):
            self.fault("R_SCOPE", "a match ruleset has no highlights or scoreboards")
        for s in stats.values():
            if s.kind == "rate":
                for other in (s.value or s.options["rate"], s.options.get("of")):
                    if isinstance(other, str) and (other not in stats or stats[other].kind != "bucket"):
                        self.fault("R_REF", f"{other!r} is no bucket", s.id)
        if self.found:
            raise RuleError(*self.found)
        return Ruleset(
            d["ruleset"], d.get("for", "each_player"), d.get("title", ""), d.get("summary", ""), d.get("enabled", True), tuple(d.get("use") or ()), tuple(d.get("exports") or ()), params, defines, stats, highlights, d.get("show") or {}
        )


def _gate(x: object) -> str | None:
    return " and ".join(f"({y})" for y in x) if isinstance(x, list) else x


class _Loader(yaml.SafeLoader):
    """YAML 1.2 booleans: ``on`` and ``off`` are words."""


_Loader.yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|false)$"), list("tf"))


def read(text: str, where: str = "ruleset") -> list[Ruleset]:
    """Rulesets of a YAML text, which may hold several documents."""
    return [_Reader(d, where).read() for d in yaml.load_all(text, _Loader) if d]


def load(folder: str | Path) -> list[Ruleset]:
    """Rulesets of a folder's YAML files."""
    return [r for p in sorted(Path(folder).glob("*.y*ml")) for r in read(p.read_text(), p.name)]


def overlaid(shipped: Iterable[Ruleset], own: Iterable[Ruleset]) -> list[Ruleset]:
    """Own rulesets replace shipped ones of the same id, as a whole; disabled ones go."""
    out = {r.id: r for r in shipped} | {r.id: r for r in own}
    return [r for r in out.values() if r.enabled]


def ordered(rulesets: Iterable[Ruleset]) -> list[Ruleset]:
    """Used rulesets before those that use them."""
    by = {r.id: r for r in rulesets}
    out: dict[str, Ruleset] = {}

    def add(r: Ruleset, above: tuple[str, ...]) -> None:
        if r.id in above:
            raise RuleError(Diagnostic("E_CYCLE", " -> ".join((*above, r.id)), where=r.id))
        for u in r.use:
            if u not in by:
                raise RuleError(Diagnostic("R_REF", f"uses {u!r}, which is none", where=r.id))
            add(by[u], (*above, r.id))
        out.setdefault(r.id, r)

    for r in by.values():
        add(r, ())
    return list(out.values())
