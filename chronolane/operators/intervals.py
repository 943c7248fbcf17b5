"""Interval algebra on (start_us, end_us) rows, half-open."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolane.model import TIME
from chronolane.sources.shared import written

from . import scan


def stab(runs: DataFrame, points: DataFrame, by: list[str], bucket_us: int) -> DataFrame:
    """The runs that hold each point (by, at_us). Runs are filed under the time buckets they touch, so the join has an equi-key."""
    last = F.floor((F.col("end_us") - 1) / bucket_us)
    first = F.floor(F.col("start_us") / bucket_us)
    filed = runs.where("end_us > start_us").withColumn("_b", F.explode(F.sequence(first, last)))
    asked = points.withColumn("_b", F.floor(F.col("at_us") / bucket_us))
    return filed.join(asked, [*by, "_b"]).where("at_us >= start_us and at_us < end_us").drop("_b")


def merge_overlapping(runs: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping runs as one; runs that only touch stay apart."""
    w = Window.partitionBy(*by).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = runs.withColumn("_new", F.when(F.col("start_us") < reach, 0).otherwise(1)).withColumn("_grp", F.sum("_new").over(w))
    return grouped.groupBy(*by, "_grp").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("n")
    ).drop("_grp")


def boundaries(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, at_us): the distinct starts and ends."""
    return runs.select(*by, F.col("start_us").alias("at_us")).union(runs.select(*by, F.col("end_us"))).distinct()


def next_event(runs: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """For each point (by, at_us) the first boundary after it, null if there is none."""
    marks = boundaries(runs, by).select(*by, F.col("at_us").alias("t_us"), F.lit(True).alias("mark"))
    asked = points.select(*by, F.col("at_us").alias("t_us"), F.lit(False).alias("mark"))
    w = Window.partitionBy(*by).orderBy(F.desc("t_us"), "mark").rowsBetween(Window.unboundedPreceding, -1)  # backwards, so that one pass does
    both = marks.unionByName(asked).withColumn("next_us", F.min(F.when(F.col("mark"), F.col("t_us"))).over(w))
    return both.where("not mark").select(*by, F.col("t_us").alias("at_us"), "next_us")


def visible(layers: DataFrame, by: list[str]) -> DataFrame:
    """``layers`` (by, layer, start_us, end_us, v) as runs that don't overlap within a layer: at any time the run that started last shows (of several the one with the greatest v).

    One pass over each layer's sorted runs, with a stack of those that are still open; at most two pieces for each run.
    """
    keys = [*by, "layer"]
    rows = layers.where("end_us > start_us").select(*keys, "start_us", "end_us", "v")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "start_us", F.asc_nulls_first("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now, open_runs, out = None, 0, [], []

        def upto(time: int | None) -> None:
            nonlocal now
            while open_runs and (time is None or now < time):
                end, v = open_runs[-1]
                if end <= now:
                    open_runs.pop()
                    continue
                stop = end if time is None else min(end, time)
                out.append((*group, now, stop, v))
                now = stop

        def table() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "start_us", "end_us", "v"])

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = kinds or [c.type for c in batch.columns]
            for *own, start, end, v in zip(*(c.to_pylist() for c in batch.columns)):
                if own != group:
                    upto(None)
                    group, now = own, start
                    open_runs.clear()
                upto(start)
                now = start
                # What ends no later than a run that started after it never shows again.
                while open_runs and open_runs[-1][0] <= end:
                    open_runs.pop()
                open_runs.append((end, v))
            if out:
                yield table()
        upto(None)
        if out:
            yield table()

    return rows.mapInArrow(run, rows.schema)


def overlay(layers: DataFrame, by: list[str], width: int | None = None) -> DataFrame:
    """Elementary segments between all boundaries of ``layers`` (by, layer, start_us, end_us, v), one row for each segment and layer that covers it.

    Where two runs of one layer cover a segment, the one that starts last counts
    (then the greatest value). Segments that no layer covers have no rows. ``width``:
    see ``scan``, for logs with more boundaries than a task should sort.
    """
    layers = written(layers)  # read for the boundaries and for the pieces
    cuts = boundaries(layers, by).withColumnRenamed("at_us", TIME)
    # The last boundary begins no segment, so the numbers of segments are those of boundaries.
    each = scan.along(cuts, by, [TIME], width, seg=scan.ordinal(), _next=scan.following(TIME))
    segments = each.select(*by, F.col(TIME).alias("from_us"), F.col(f"_next.{TIME}").alias("to_us"), "seg").where("to_us is not null")
    # Visible pieces begin and end at boundaries, so each unfolds into its own segments, which are the rows of the result, by a count of boundaries.
    numbered = written(segments)
    first = numbered.select(*by, F.col("from_us").alias("start_us"), F.col("seg").alias("first_seg"))
    last = numbered.select(*by, F.col("to_us").alias("end_us"), F.col("seg").alias("last_seg"))
    unfolded = (
        visible(layers, by)
        .join(first, [*by, "start_us"])
        .join(last, [*by, "end_us"])
        .withColumn("seg", F.explode(F.sequence("first_seg", "last_seg")))
    )
    return numbered.join(unfolded.select(*by, "layer", "seg", "v"), [*by, "seg"]).select(*by, "layer", "from_us", "to_us", "v")
