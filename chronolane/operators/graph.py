"""Closure and levels of a dependency graph, by rounds of joins; each round's rows are written, so plans stay short."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.sources.shared import written


def closure(edges: DataFrame) -> DataFrame:
    """(node, needs) over any number of steps, as many rounds as the longest path has edges; a cycle is an error."""
    edges = written(edges.select("node", "needs").distinct())
    onwards = edges.select(F.col("node").alias("needs"), F.col("needs").alias("_further"))
    known = front = edges
    while True:
        step = front.join(onwards, "needs").select("node", F.col("_further").alias("needs")).distinct()
        front = written(step.join(known, ["node", "needs"], "left_anti"))
        if front.isEmpty():
            return known
        around = front.where("node = needs").first()
        if around is not None:
            raise ValueError(f"a cycle through {around['node']}")
        known = known.unionByName(front)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the longest path below each node; edges to nodes not listed don't count, a cycle is an error."""
    nodes = nodes.select("node").distinct()
    own = written(edges.select("node", "needs").distinct().join(nodes, "node", "left_semi").join(nodes.withColumnRenamed("node", "needs"), "needs", "left_semi"))
    # Nodes with a path of so many edges below them: each round's are among those of the round before.
    rounds, size = [nodes], None
    while size != 0:
        longer = written(own.join(rounds[-1].withColumnRenamed("node", "needs"), "needs", "left_semi").select("node").distinct())
        before, size = size, longer.count()
        if size and size == before:
            raise ValueError(f"a cycle below {longer.first()['node']}")
        rounds.append(longer)
    each = [r.withColumn("level", F.lit(i)) for i, r in enumerate(rounds[:-1])]
    return reduce(DataFrame.unionByName, each).groupBy("node").agg(F.max("level").alias("level"))
