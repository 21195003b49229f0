"""Sources of logs: which one a log comes from, and what its logical events are called there."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.rules.catalog import Catalog


@dataclass(frozen=True)
class Profile:
    """A kind of recorder and a range of builds; ``logical``: concrete events of each ``$name``, none where a source has no such event."""

    name: str
    kind: str
    builds: tuple[int, int] = (0, 1 << 31)
    logical: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


# Ends of rounds by recorder.
PROFILES = [
    Profile("gotv", "gotv", logical={"$round_end": ("round_officially_ended", "cs_win_panel_match")}),
    Profile("hltv", "hltv", logical={"$round_end": ("round_officially_ended", "cs_win_panel_match")}),
    Profile("unknown", "unknown", logical={"$round_end": ("round_officially_ended",)}),
]


def pick(profiles: Iterable[Profile], kind: str, build: int) -> Profile | None:
    """The profile of a kind whose range holds the build; the narrowest of several."""
    fits = [p for p in profiles if p.kind == kind and p.builds[0] <= build <= p.builds[1]]
    return min(fits, key=lambda p: (p.builds[1] - p.builds[0], p.name), default=None)


def resolved(catalog: Catalog, profile: Profile) -> tuple[Catalog, list[str]]:
    """The catalog with concrete events for logical ones, and the views that this source cannot offer."""
    views, missing = {}, []
    for name, v in catalog.views.items():
        events = tuple(c for e in v.events for c in (profile.logical.get(e, ()) if e.startswith("$") else (e,)))
        if events:
            views[name] = replace(v, events=events)
        else:
            missing.append(name)
    return replace(catalog, views=views), missing


def restarts(log: DataFrame, candidates: Iterable[str] = ("begin_new_match", "cs_pre_restart", "round_announce_match_start")) -> DataFrame:
    """match_id and the restart event that each match uses: the first candidate that occurs in it."""
    seen = log.where(F.col("event").isin(list(candidates))).groupBy("match_id").agg(F.collect_set("event").alias("seen"))
    first = F.coalesce(*[F.when(F.array_contains("seen", c), c) for c in candidates])
    return seen.select("match_id", first.alias("restart"))
