"""Connected components of an edge list by alternating large-star and small-star steps.

Each round is two aggregations and two joins; its edge list is written to the
shared folder, so plans stay short and lost executors can be recomputed. Edges
are pairs of longs; a hot node only ever meets its own minimum, and its rows
are spread by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s"),
    ).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.union(kept).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not its component's smallest; ``edges`` has longs u and v.

    Self-edges, repeated and reversed edges and rows with a null end are no
    links. An empty edge list gives an empty result.
    """
    now = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    sign = _signature(now)
    while sign[0]:
        then = written(_small_star(_large_star(now)))
        forget(now)
        now, before, sign = then, sign, _signature(then)
        if before == sign:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
