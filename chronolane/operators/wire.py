"""Logs of the wire format: fields, lanes, default rules.

``fields`` turns payloads into one value v for each row: the payload's own field
where it has one, its JSON text where it is a structure. All operators then work
on v, and ``painted`` shows each frame's state as lanes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.functions.fuzzy import ratio
from chronolane.functions.text import casefold
from chronolane.model import LOG, TIME

from . import rules, runs, temporal

KEYS = ["signal", "key"]
LANE = ["lane", "arm", "col", "tag"]
#: The field that a payload's value is read from; payloads not named here are structures.
FIELD = {"status": "status", "arm": "digit", "instrument": "name", "pedals": "pressed", "pedal_label": "text", "laser": "on", "banner": "text"}
BOX = "struct<x:int,y:int,w:int,h:int>"
SHAPES = {
    "layout": f"pods array<struct<column:int,role:string,box:{BOX}>>",
    "popups": f"messages array<struct<text:string,box:{BOX}>>",
    "offscreen": "bars array<struct<score:double,status:string,arm:int>>",
    "tool_association": "badges array<struct<score:double,arm:int>>",
}
LABEL_LEAST = 55


def fields(obs: DataFrame) -> DataFrame:
    """``obs`` with v, col (the first key part as a number) and color (the second); the payload itself is dropped."""
    v: Column = F.col("value")
    for signal, name in FIELD.items():
        v = F.when(F.col("signal") == signal, F.get_json_object("value", f"$.{name}")).otherwise(v)
    return obs.withColumns({"v": v, "col": F.get("key", F.lit(0)).try_cast("int"), "color": F.get("key", F.lit(1))}).drop("value")


def complete(layout: Column) -> Column:
    """Whether every pod of a layout's JSON has a box and one is the camera."""
    pods = F.coalesce(F.from_json(layout, SHAPES["layout"])["pods"], F.array().cast("array<struct<column:int,role:string,box:struct<x:int,y:int,w:int,h:int>>>"))
    return F.forall(pods, lambda p: p["box"].isNotNull()) & F.exists(pods, lambda p: p["role"] == "camera")


def _structure(state: DataFrame, signal: str, part: str) -> DataFrame:
    own = state.where(F.col("signal") == signal)
    return own.select("*", F.posexplode(F.from_json("v", SHAPES[signal])[part]).alias("_at", "item"))


def _lane(rows: DataFrame, lane, arm, col, v, tag=None) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        LOG,
        "fo",
        (F.lit(lane) if isinstance(lane, str) else lane).alias("lane"),
        (none if arm is None else arm).cast("int").alias("arm"),
        (none if col is None else col).cast("int").alias("col"),
        (none if tag is None else tag).cast("string").alias("tag"),
        (none if v is None else v).cast("string").alias("v"),
    )


def actions_of(presses: DataFrame, actions: DataFrame) -> DataFrame:
    """``presses`` (instrument, color, label) with ``action``.

    ``actions``: (alias, color, labels). No instrument, no entry or no labels: null;
    one label: it; several: the one most like the held label, 55 at least, the
    first of equals.
    """
    known = actions.select(casefold(F.col("alias")).alias("_a"), "color", "labels")
    joined = presses.withColumn("_a", casefold(F.col("instrument"))).join(known, ["_a", "color"], "left")
    several = joined.where(F.size("labels") > 1).select("_a", "color", "label", F.posexplode("labels").alias("_i", "option")).distinct()
    close = several.where("label is not null").withColumn("_r", ratio(F.lower("label"), F.col("option"))).where(F.col("_r") >= LABEL_LEAST)
    best = close.groupBy("_a", "color", "label").agg(F.max_by("option", F.struct("_r", -F.col("_i"))).alias("_best"))
    chosen = joined.join(best, ["_a", "color", "label"], "left")
    return chosen.withColumn("action", F.when(F.size("labels") == 1, F.get("labels", F.lit(0))).when(F.size("labels") > 1, F.col("_best"))).drop("_a", "_best", "labels")


def painted(obs: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames, and (log_id, fo, lane, arm, col, tag, v): every lane of every frame. Frames without a layout show ``no_ui`` alone."""
    grid = temporal.frames(obs)
    state = temporal.carry_forward(obs, KEYS).withColumns({"col": F.get("key", F.lit(0)).try_cast("int"), "color": F.get("key", F.lit(1))})
    arms = state.where("signal = 'arm'").select(LOG, "fo", "col", F.col("v").try_cast("int").alias("digit"))
    armed = state.join(arms, [LOG, "fo", "col"], "left").withColumn("arm", F.coalesce("digit", "col"))
    arm, col, v = F.col("arm"), F.col("col"), F.col("v")
    pods = _structure(state, "layout", "pods").where("item.role = 'camera'").withColumn("col", F.col("item.column"))
    pods = pods.join(arms, [LOG, "fo", "col"], "left").withColumn("arm", F.coalesce("digit", "col"))
    mounted = state.where("signal = 'instrument'").select(LOG, "fo", "col", F.col("v").alias("instrument"))
    labels = state.where("signal = 'pedal_label'").select(LOG, "fo", "col", "color", F.col("v").alias("label"))
    presses = armed.where("signal = 'pedals' and v = 'true'").join(mounted, [LOG, "fo", "col"], "left").join(labels, [LOG, "fo", "col", "color"], "left")
    pressed = actions_of(presses, actions)
    parts = [
        _lane(pods, "role", arm, col, F.lit("camera")),
        _lane(armed.where("signal = 'status'"), "status", arm, col, v),
        _lane(armed.where("signal = 'instrument'"), "instrument", arm, col, v),
        _lane(pressed, F.concat(F.lit("pedal_"), F.col("color")), arm, col, F.col("action")),
        _lane(armed.where("signal = 'laser' and v = 'true'"), "laser", arm, col, None),
        _lane(_structure(armed, "popups", "messages"), "popup", arm, col, F.col("item.text"), F.col("item.text")),
        _lane(state.where("signal = 'banner'"), "banner", None, None, v),
    ]
    bars = _structure(state, "offscreen", "bars").where("item.arm is not null").groupBy(LOG, "fo", F.col("item.arm").alias("arm"))
    parts.append(_lane(bars.agg(F.max_by(F.struct("item.status"), "_at").alias("last")), "offscreen", arm, None, F.col("last.status")))
    parts.append(_lane(_structure(state, "tool_association", "badges").where("item.arm is not null"), "tool_association", F.col("item.arm"), None, None))
    lit = state.where("signal = 'layout'").select(LOG, "fo").distinct()
    shown = reduce(DataFrame.unionByName, parts).join(lit, [LOG, "fo"], "left_semi").dropDuplicates([LOG, "fo", *LANE])
    return grid, shown.unionByName(_lane(grid.join(lit, [LOG, "fo"], "left_anti"), "no_ui", None, None, None))


def interval_view(obs: DataFrame, actions: DataFrame) -> DataFrame:
    """(log_id, lane, arm, col, start_us, end_us, v): one row for each run of each lane."""
    grid, shown = painted(obs, actions)
    return runs.encode_runs(grid, shown, LANE).drop("tag")


@dataclass(frozen=True)
class CompleteLayout:
    """A run of incomplete layouts is kept only between complete ones and if ``max_us`` long at most; else it reads as absent."""

    max_us: int
    signal: str = "layout"

    def patches(self, obs: DataFrame, keys: list[str]) -> DataFrame:
        kind = F.when(F.col("v").isNull(), 0).when(complete(F.col("v")), 2).otherwise(1)
        spans = runs.island_spans(obs.where("signal = 'layout'"), [LOG, *keys], kind)
        kept = F.coalesce((F.col("before.kind") == 2) & (F.col("after.kind") == 2) & (F.col("next_us") - F.col("start_us") <= self.max_us), F.lit(False))
        return spans.where((F.col("kind") == 1) & ~kept).select(
            LOG, *keys, "start_us", "end_us", F.lit("set").alias("action"), F.lit(None).cast("string").alias("value")
        )


@dataclass(frozen=True)
class PressNeedsAction:
    """A fresh press is released if its instrument's entry declares no label at all for the color; what is not known gives no opinion."""

    actions: DataFrame
    signal: str = "pedals"

    def patches(self, obs: DataFrame, keys: list[str]) -> DataFrame:
        fresh = obs.where("signal = 'pedals' and v = 'true'")
        held = temporal.asof(fresh, obs.where("signal = 'instrument'"), [LOG, "col"], ["v"]).where("got.v is not null")
        silent = self.actions.where(F.size("labels") == 0).select(casefold(F.col("alias")).alias("_a"), "color")
        hit = held.withColumn("_a", casefold(F.col("got.v"))).join(silent, ["_a", "color"], "left_semi")
        return hit.select(LOG, *keys, F.col(TIME).alias("start_us"), F.col(TIME).alias("end_us"), F.lit("set").alias("action"), F.lit("false").alias("value"))


def default_rules(actions: DataFrame) -> list:
    """The declared corrections in their order: layout first, then signal by signal."""
    return [
        CompleteLayout(1_000_000),
        rules.Debounce("status", 150_000, "inactive"),
        rules.Debounce("arm", 150_000),
        rules.UniqueByScore("arm"),
        rules.RequiresHeld("pedals", "instrument", "false"),
        PressNeedsAction(actions),
        rules.Debounce("pedals", 50_000, "false"),
        rules.Debounce("laser", 1_000_000, "false"),
    ]


rules.RULES |= {"complete_layout": CompleteLayout, "press_needs_action": PressNeedsAction}
