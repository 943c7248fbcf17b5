"""Times as people write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed steps, in seconds, from which a time axis takes its ticks.
TICK_STEPS = (1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600)


def parsed(text: Column) -> Column:
    """``h:mm:ss.f``, or any number of base-60 parts, in seconds; null if a part is no number."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)


def formatted(seconds: Column, millis: bool = False) -> Column:
    """``HH:MM:SS``, with ``.mmm`` if asked; times under zero read as zero."""
    ms = F.greatest(F.round(seconds * 1000).cast("long"), F.lit(0).cast("long"))
    s = F.floor(ms / 1000)
    clock = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))
    return F.concat(clock, F.format_string(".%03d", F.pmod(ms, F.lit(1000)))) if millis else clock


def tick_step(span: Column) -> Column:
    """The first step that gives 4 to 14 ticks, else an eighth of the span."""
    steps = F.filter(F.array(*[F.lit(float(s)) for s in TICK_STEPS]), lambda s: (span / s >= 4) & (span / s <= 14))
    return F.coalesce(F.get(steps, F.lit(0)), span / 8)
