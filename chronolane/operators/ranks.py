"""Places in one order over a whole table, without one task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.sources.shared import written


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in the order given (which should have no ties).

    Rows are dealt out by range and sorted; each partition counts its own, and one
    row for each partition tells how many come before it.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    fixed = written(dealt.select("*", F.shiftrightunsigned("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    counts = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row for each partition
    return fixed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).select(*rows.columns, name)
