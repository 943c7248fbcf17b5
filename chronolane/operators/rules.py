"""Correction rules: window predicates that yield patches, folded in order.

A rule takes the log as corrected so far and returns rows of (log_id, keys,
start_us, end_us, action, value). Values are of whatever type column v has;
``neutral`` is the value that reads as "off", null for confirmed absence.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.model import LOG, POS, TIME
from chronolane.sources.shared import written

from .patches import apply_patches
from .runs import island_spans
from .temporal import asof

PATCH = ["start_us", "end_us", "action", "value"]


def _value(rows: DataFrame, x) -> Column:
    """A constant of the type that the log's values have."""
    return F.lit(x).cast(rows.schema["v"].dataType)


def _point(rows: DataFrame, keys: list[str], value) -> DataFrame:
    return rows.select(
        LOG, *keys, F.col(TIME).alias("start_us"), F.col(TIME).alias("end_us"), F.lit("set").alias("action"), _value(rows, value).alias("value")
    )


@dataclass(frozen=True)
class Debounce:
    """A run of one value that is not neutral and lasts under ``min_us`` reads as neutral."""

    signal: str
    min_us: int
    neutral: int | str | None = None

    def patches(self, obs: DataFrame, keys: list[str]) -> DataFrame:
        kind = F.when(~F.col("v").eqNullSafe(_value(obs, self.neutral)), F.col("v"))
        spans = island_spans(obs.where(F.col("signal") == self.signal), [LOG, *keys], kind)
        return spans.where("kind is not null").where(F.col("end_us") - F.col("start_us") < self.min_us).select(
            LOG, *keys, "start_us", "end_us", F.lit("set").alias("action"), _value(obs, self.neutral).alias("value")
        )


@dataclass(frozen=True)
class FillGap:
    """A neutral or absent run between equal values, ``max_us`` long at most, reads as the value before it."""

    signal: str
    max_us: int
    neutral: int | str | None = None

    def patches(self, obs: DataFrame, keys: list[str]) -> DataFrame:
        kind = F.when(~F.col("v").eqNullSafe(_value(obs, self.neutral)), F.col("v"))
        spans = island_spans(obs.where(F.col("signal") == self.signal), [LOG, *keys], kind)
        return spans.where(
            F.col("kind").isNull()
            & (F.col("before.kind") == F.col("after.kind"))
            & (F.col("next_us") - F.col("start_us") <= self.max_us)
        ).select(LOG, *keys, "start_us", F.col("next_us").alias("end_us"), F.lit("set").alias("action"), F.col("before.kind").alias("value"))


@dataclass(frozen=True)
class BracketedGap:
    """A run of incomplete values is kept only between complete ones and if ``max_us`` long at most; else it reads as absent."""

    signal: str
    max_us: int
    complete_from: int

    def patches(self, obs: DataFrame, keys: list[str]) -> DataFrame:
        kind = F.when(F.col("v") >= self.complete_from, 2).when(F.col("v").isNotNull(), 1).otherwise(0)
        spans = island_spans(obs.where(F.col("signal") == self.signal), [LOG, *keys], kind)
        kept = F.coalesce(
            (F.col("before.kind") == 2) & (F.col("after.kind") == 2) & (F.col("next_us") - F.col("start_us") <= self.max_us), F.lit(False)
        )
        return spans.where((F.col("kind") == 1) & ~kept).select(
            LOG, *keys, "start_us", "end_us", F.lit("set").alias("action"), _value(obs, None).alias("value")
        )


@dataclass(frozen=True)
class RequiresHeld:
    """A fresh value of ``signal`` while ``other`` holds nothing is released to ``neutral``; both are matched by column ``by``."""

    signal: str
    other: str
    neutral: int | str | None = None
    by: str = "col"

    def patches(self, obs: DataFrame, keys: list[str]) -> DataFrame:
        fresh = obs.where((F.col("signal") == self.signal) & F.col("v").isNotNull() & ~F.col("v").eqNullSafe(_value(obs, self.neutral)))
        held = asof(fresh, obs.where(F.col("signal") == self.other), [LOG, self.by], ["v"])
        return _point(held.where("got.v is null"), keys, self.neutral)


@dataclass(frozen=True)
class UniqueByScore:
    """Of fresh rows of ``signal`` in one frame with one value, the best score keeps it (then the first); the rest read as absent."""

    signal: str

    def patches(self, obs: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(LOG, "frame", "v").orderBy(F.desc("score"), POS)
        rows = obs.where((F.col("signal") == self.signal) & F.col("v").isNotNull())
        return _point(rows.withColumn("_n", F.row_number().over(w)).where("_n > 1"), keys, None)


RULES = {"debounce": Debounce, "fill_gap": FillGap, "bracketed_gap": BracketedGap, "requires_held": RequiresHeld, "unique_by_score": UniqueByScore}


def settings(rule) -> dict:
    """A rule as the plain settings that a log's header keeps; tables that it reads are left out."""
    kind = next(k for k, c in RULES.items() if type(rule) is c)
    plain = {f.name: getattr(rule, f.name) for f in fields(rule)}
    return {"name": f"{kind}:{rule.signal}", **{k: v for k, v in plain.items() if not isinstance(v, DataFrame)}}


def from_settings(entries: list[dict], **tables: DataFrame) -> list:
    """Rules from their settings; an unknown kind and a time that is no number are errors.

    ``tables``: what rules read besides the log, by the name of their field.
    """
    out = []
    for entry in entries:
        kind = str(entry.get("name", "")).partition(":")[0]
        if kind not in RULES:
            raise ValueError(f"unknown rule {kind!r}; known: {', '.join(sorted(RULES))}")
        given = {k: v for k, v in entry.items() if k != "name"}
        for name in ("min_us", "max_us"):
            if name in given and (isinstance(given[name], bool) or not isinstance(given[name], (int, float))):
                raise TypeError(f"{name} must be a number, not {given[name]!r}")
        rule = RULES[kind]
        out.append(rule(**given, **{f.name: tables[f.name] for f in fields(rule) if f.name in tables}))
    return out


def corrected(obs: DataFrame, patches: DataFrame | None, keys: list[str]) -> DataFrame:
    """``obs`` with patches applied to the signals that they name."""
    return obs if patches is None else apply_patches(obs, patches, ["signal", *keys])


def correct(obs: DataFrame, rules: list, keys: list[str]) -> DataFrame:
    """All patches of ``rules`` in order, with signal and patch_idx; each rule sees the log with those before it applied."""
    out = None
    for number, rule in enumerate(rules):
        own = Window.partitionBy(LOG).orderBy("start_us", "end_us", *keys)
        if number:  # only the last rule's patches are laid over what the others have corrected
            obs = corrected(obs, found, keys)
        found = (
            rule.patches(obs, keys)
            .withColumn("signal", F.lit(rule.signal))
            .withColumn("patch_idx", F.lit(number << 40) + F.row_number().over(own))
        )
        if number < len(rules) - 1:  # the next rule reads them twice
            found = written(found)
        out = found if out is None else out.unionByName(found)
    return out
