"""Streaming forms of the stateful operators.

State is kept by (match, player).  Counts and tallies are plain aggregations;
streaks, bursts and edges are an ``applyInPandasWithState`` over each key's
events in the order of their sequence numbers.  Within a batch events of a key
are sorted; an event that is older than what its key has already seen is dropped
and counted, so results do not depend on the cutting of batches as long as a
key's events arrive in order across batches.  State of matches that are over goes
after ``forget`` milliseconds without an event of the key, if given; it has no
effect on results but for events that come later still.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STREAK = "match_id string, player long, streaks long, open_run long, late long"
PULSE = "match_id string, player long, seq long, tick long"
_RUN = "last_seq long, last_tick long, round long, run long, streaks long, late long"
_RING = "last_seq long, ticks array<long>, inside boolean"
_FLAG = "last_seq long, on boolean, round long"


def counts(events: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """Running counts; complete or update mode."""
    return events.groupBy(*by).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def session_streaks(events: DataFrame, gap: str, least: int, late: str = "1 day") -> DataFrame:
    """Streaks without rounds as session windows, with a watermark on ``ts``.  A session's gap excludes its end: pass one unit more than a streak's."""
    runs = events.withWatermark("ts", late).groupBy("match_id", "player", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).select("match_id", "player", F.col("session_window.start").alias("start"), "n")


def streaks(events: DataFrame, gap: int, least: int, forget: int | None = None) -> DataFrame:
    """match_id, player, streaks so far (closed runs), length of the open one, late events.

    ``events``: match_id, player, round, seq, tick.  A new round closes a run.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_seq, last_tick, round_, run, done, late = state.get if state.exists else (-1, 0, -1, 0, 0, 0)
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.seq <= last_seq:
                late += 1
                continue
            if run and r.round == round_ and r.tick - last_tick <= gap:
                run += 1
            else:
                done += run >= least
                run = 1
            last_seq, last_tick, round_ = r.seq, r.tick, r.round
        _keep(state, (last_seq, last_tick, round_, run, done, late), forget)
        yield pd.DataFrame({"match_id": [key[0]], "player": [key[1]], "streaks": [done], "open_run": [run], "late": [late]})

    return _keyed(events).applyInPandasWithState(step, STREAK, _RUN, "update", _timeout(forget))


def bursts(events: DataFrame, gap: int, least: int, forget: int | None = None) -> DataFrame:
    """A row where the ``least``-th event of a rolling window lands; the state is a ring of the last ticks."""
    n = max(2, least)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_seq, ticks, inside = state.get if state.exists else (-1, [], False)
        ticks, out = list(ticks), []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.seq <= last_seq:
                continue
            ticks = [*ticks, r.tick][-n:]
            now = len(ticks) == n and r.tick - ticks[0] <= gap
            if now and not inside:
                out.append((key[0], key[1], r.seq, r.tick))
            inside, last_seq = now, r.seq
        _keep(state, (last_seq, ticks, inside), forget)
        yield pd.DataFrame(out, columns=["match_id", "player", "seq", "tick"])

    return _keyed(events).applyInPandasWithState(step, PULSE, _RING, "append", _timeout(forget))


def rising(events: DataFrame, condition: str, forget: int | None = None) -> DataFrame:
    """A row where a boolean column turns true; a new round starts from false."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_seq, on, round_ = state.get if state.exists else (-1, False, -1)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
            if r["seq"] <= last_seq:
                continue
            now = bool(r[condition]) if r[condition] is not None else False
            if now and not (on and r["round"] == round_):
                out.append((key[0], key[1], r["seq"], r["tick"]))
            on, round_, last_seq = now, r["round"], r["seq"]
        _keep(state, (last_seq, on, round_), forget)
        yield pd.DataFrame(out, columns=["match_id", "player", "seq", "tick"])

    return _keyed(events).applyInPandasWithState(step, PULSE, _FLAG, "append", _timeout(forget))


def _timeout(forget: int | None) -> str:
    return GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout


def _keep(state: GroupState, value: tuple, forget: int | None) -> None:
    state.update(value)
    if forget is not None:
        state.setTimeoutDuration(forget)


def _keyed(events: DataFrame):
    return events.groupBy("match_id", "player")
