"""Case summaries: one conditional aggregation over a log's intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.model import LOG


def span() -> Column:
    return F.col("end_us") - F.col("start_us")


def totals(runs: DataFrame, lanes: dict[str, str]) -> DataFrame:
    """One row a log: for each lane its count and duration, under the names given."""
    return runs.groupBy(LOG).agg(*_totals(lanes))


def _totals(lanes: dict[str, str]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("intervals")]
    for lane, name in lanes.items():
        own = F.col("lane") == lane
        out += [F.count_if(own).alias(f"{name}_count"), F.coalesce(F.sum(F.when(own, span())), F.lit(0)).alias(f"{name}_us")]
    return out


def uses(runs: DataFrame, lane: str) -> DataFrame:
    """(log_id, v, place, duration_us, cols): values of a lane by first appearance, nulls skipped."""
    known = runs.where((F.col("lane") == lane) & F.col("v").isNotNull())
    each = known.groupBy(LOG, "v").agg(
        F.sum(span()).alias("duration_us"),
        F.min(F.struct("start_us", "col")).alias("_first"),
        F.array_join(F.sort_array(F.collect_set(F.col("col").cast("string"))), ",").alias("cols"),
    )
    place = F.row_number().over(Window.partitionBy(LOG).orderBy("_first", "v"))
    return each.select(LOG, "v", place.alias("place"), "duration_us", "cols")


def changes(runs: DataFrame, lane: str) -> DataFrame:
    """(log_id, changes): values that follow a different value under the same key, nulls skipped."""
    known = runs.where((F.col("lane") == lane) & F.col("v").isNotNull())
    before = F.lag("v").over(Window.partitionBy(LOG, "col").orderBy("start_us"))
    return known.withColumn("_b", before).groupBy(LOG).agg(F.count_if(F.col("_b") != F.col("v")).alias("changes"))


def summarize(runs: DataFrame, lanes: dict[str, str], mount: str) -> DataFrame:
    """Totals, number of distinct mounts and mount changes of each log, in one pass over ``runs``."""
    before = Window.partitionBy(LOG, "lane", "col").orderBy("start_us").rowsBetween(Window.unboundedPreceding, -1)
    mounted = F.when(F.col("lane") == mount, F.col("v"))
    seen = runs.withColumn("_before", F.last(mounted, True).over(before))
    return seen.groupBy(LOG).agg(*_totals(lanes), F.count_distinct(mounted).alias("mounts"), F.count_if(mounted != F.col("_before")).alias("changes"))


def footer(obs: DataFrame, gate: str) -> DataFrame:
    """Counts and the achieved rate of each log: frames over the span of the gate's samples, 0 if they span nothing."""
    digest = obs.groupBy(LOG).agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(F.col("signal") == gate).alias("frames_sampled"),
        (F.max(F.when(F.col("signal") == gate, F.col("t_us"))) - F.min(F.when(F.col("signal") == gate, F.col("t_us")))).alias("span_us"),
    )
    n, wide = F.col("frames_sampled"), F.coalesce("span_us", F.lit(0))
    return digest.select(
        LOG, "observations", "frames_sampled", F.when(wide > 0, F.round((n - 1) * F.lit(3600000000.0) / wide, 3)).otherwise(F.lit(0.0)).alias("achieved_per_hour")
    )
