"""Boxes (x, y, w, h) in pixels as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[v.cast("long").alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])


def offset(inner: Column, outer: Column) -> Column:
    """A box told in a region's own pixels, in the frame's."""
    return box(inner["x"] + outer["x"], inner["y"] + outer["y"], inner["w"], inner["h"])


def from_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return box(F.round(x0), F.round(y0), F.round(x1) - F.round(x0), F.round(y1) - F.round(y0))


def column_bounds(region: Column, columns: int = 4) -> Column:
    """(column, x, w) of equal columns; the last takes what is left."""
    each = F.floor(region["w"] / columns)
    return F.transform(
        F.sequence(F.lit(0), F.lit(columns - 1)),
        lambda i: F.struct(
            (i + 1).cast("long").alias("column"),
            (region["x"] + i * each).alias("x"),
            F.when(i == columns - 1, region["w"] - i * each).otherwise(each).alias("w"),
        ),
    )


def end_centers(bar: Column) -> Column:
    """The centers of a bar's two end squares, along its longer side."""
    wide = bar["w"] >= bar["h"]
    half = F.floor(F.least(bar["w"], bar["h"]) / 2)
    return F.struct(
        F.when(wide, bar["x"] + half).otherwise(bar["x"] + F.floor(bar["w"] / 2)).alias("x1"),
        F.when(wide, bar["y"] + F.floor(bar["h"] / 2)).otherwise(bar["y"] + half).alias("y1"),
        F.when(wide, bar["x"] + bar["w"] - half).otherwise(bar["x"] + F.floor(bar["w"] / 2)).alias("x2"),
        F.when(wide, bar["y"] + F.floor(bar["h"] / 2)).otherwise(bar["y"] + bar["h"] - half).alias("y2"),
    )


def union_box(box_col: str) -> list[Column]:
    """Aggregates x, y, w, h of the smallest box around all."""
    x, y, w, h = (F.col(f"{box_col}.{n}") for n in "xywh")
    return [
        F.min(x).alias("x"),
        F.min(y).alias("y"),
        (F.max(x + w) - F.min(x)).alias("w"),
        (F.max(y + h) - F.min(y)).alias("h"),
    ]
