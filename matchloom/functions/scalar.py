"""Scalar functions of the rule language and of its tables, as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weapons that fire no single bullets.
NO_BULLETS = ["nova", "xm1014", "mag7", "sawedoff", "hegrenade", "flashbang", "smokegrenade", "molotov", "incgrenade", "inferno", "decoy", "taser", "c4", "world", "bayonet"]
SIDES = {2: "T", 3: "CT"}


def divide(a: Column, b: Column, whole: bool = False) -> Column:
    """a / b, and 0 for a zero divisor; ``whole``: truncated towards zero."""
    if whole:
        # the divisor is never 0, whichever branch is evaluated
        safe = F.when(b == 0, F.lit(1)).otherwise(b)
        quotient = a.cast("double") / safe
        return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.when(quotient < 0, F.ceil(quotient)).otherwise(F.floor(quotient)))
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def truth(c: Column) -> Column:
    """Two-valued logic: unknown is false."""
    return F.coalesce(c, F.lit(False))


def seconds(ticks: Column, rate: float) -> Column:
    return ticks / F.lit(float(rate))


def clock(ticks: Column, rate: float) -> Column:
    """Ticks as m:ss."""
    s = F.floor(ticks / F.lit(float(rate)))
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def rounded(c: Column, digits: int) -> Column:
    """Half away from zero, in decimal."""
    return F.round(c, digits)


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """Value of a constant map; null for a missing key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def item(values: Column, n: int) -> Column:
    """Element of a list, from 0; null outside."""
    return F.get(values, F.lit(n))


def fires_bullets(weapon: Column) -> Column:
    """Whether a weapon name, with or without ``weapon_``, is a gun that fires single bullets."""
    name = F.regexp_replace(weapon, "^weapon_", "")
    return F.coalesce(~name.isin(NO_BULLETS) & ~name.startswith("knife"), F.lit(True))


def title(template: str, columns: Mapping[str, Column]) -> Column:
    """A template with {holes} filled in; a hole that names nothing stays as it is."""
    parts, at = [], 0
    while (a := template.find("{", at)) >= 0 and (b := template.find("}", a)) >= 0:
        name = template[a + 1 : b]
        parts.append(F.lit(template[at:a]))
        parts.append(F.coalesce(columns[name].cast("string"), F.lit("")) if name in columns else F.lit(template[a : b + 1]))
        at = b + 1
    return F.concat(*parts, F.lit(template[at:]))


def coerced(text: Column) -> dict[str, Column]:
    """A text as whole number, number and boolean, whichever it can be read as."""
    return {"int": text.try_cast("long"), "float": text.try_cast("double"), "bool": text.try_cast("boolean")}


def source_kind(server: Column, client: Column) -> Column:
    """Recorder of a log, by its header."""
    both = F.lower(F.concat_ws(" ", server, client))
    return F.when(both.contains("gotv") | both.contains("sourcetv"), "gotv").when(both.contains("hltv"), "hltv").otherwise("unknown")


def buttons(mask: Column, names: Mapping[str, int]) -> Column:
    """The first name, in order, whose bit is set."""
    out = F.lit(None).cast("string")
    for name, bit in reversed(list(names.items())):
        out = F.when(mask.bitwiseAND(bit) != 0, F.lit(name)).otherwise(out)
    return out
