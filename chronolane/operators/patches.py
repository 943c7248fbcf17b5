"""Patches: ordered rewrites laid over a log that itself never changes.

A patch has a log, a key, a span [start_us, end_us) (a point if both are equal),
an action ``delete`` or ``set``, a value, and ``patch_idx``, its place in the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from chronolane.model import LOG, TIME

ACTIONS = ("delete", "set")


def covers(t: Column, start: Column, end: Column) -> Column:
    """Half-open, except that a span of no length covers its own point."""
    return F.when(start == end, t == start).otherwise((t >= start) & (t < end))


def validated(patches: DataFrame) -> DataFrame:
    """An error for an unknown action and for a delete that carries a value."""
    wrong = (~F.col("action").isin(*ACTIONS)) | ((F.col("action") == "delete") & F.col("value").isNotNull()) | (F.col("end_us") < F.col("start_us"))
    return patches.withColumn("action", F.when(wrong, F.raise_error(F.concat(F.lit("bad patch: "), F.col("action")))).otherwise(F.col("action")))


def apply_patches(obs: DataFrame, patches: DataFrame, keys: list[str], bucket_us: int | None = None) -> DataFrame:
    """``obs`` corrected: a row goes if any patch that covers it deletes, else takes the value of the last one that sets.

    Coverage looks at time and key only, which patches never change, so applying
    them in order equals this. Time and score stay. Patches that are not
    ``validated`` are an error. Rows and patches of a key meet in one sorted pass
    that keeps the patches in force; rows times patches that cover them are never
    unfolded. ``bucket_us`` has no effect any more.
    """
    placed = validated(patches).dropna(subset=[LOG, *keys, "start_us", "end_us"])
    key = F.to_json(F.struct(LOG, *keys), {"ignoreNullFields": "false"}).alias("_key")
    # A span of no length covers its own point.
    end = F.greatest(F.col("end_us"), F.col("start_us") + 1)
    laid = placed.select(
        key, F.col("start_us").alias("_t"), F.lit(0).alias("_kind"), end.alias("_end"), (F.col("action") == "delete").alias("_gone"), F.col("value").cast(obs.schema["v"].dataType).alias("_v"), F.col("patch_idx").cast("long").alias("_idx")
    )
    rows = obs.select(key, F.col(TIME).alias("_t"), F.lit(1).alias("_kind"), F.struct("*").alias("_row"))
    both = laid.unionByName(rows, allowMissingColumns=True).repartition("_key").sortWithinPartitions("_key", F.asc_nulls_first("_t"), "_kind")
    out = StructType([StructField("_row", rows.schema["_row"].dataType), StructField("_set", BooleanType()), StructField("_v", obs.schema["v"].dataType)])
    done = both.mapInArrow(_applied, out)
    return done.select("_row.*", "_set", "_v").withColumn("v", F.when(F.col("_set"), F.col("_v")).otherwise(F.col("v"))).select(*obs.columns)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that stay, each with whether a patch sets it and to what; ``sets`` is a heap whose top is the last of the list."""
    key, gone, sets, live = None, None, [], 0
    for batch in batches:
        at, is_set, values = [], [], []
        columns = (batch[c].to_pylist() for c in ("_key", "_t", "_kind", "_end", "_gone", "_v", "_idx"))
        for i, (k, t, kind, end, deletes, v, idx) in enumerate(zip(*columns)):
            if k != key:
                key, gone, sets, live = k, None, [], 0
            if kind == 0:
                if deletes:
                    gone = end if gone is None else max(gone, end)
                else:
                    if len(sets) > 2 * live + 1000:  # ended ones below the top
                        sets = [s for s in sets if s[1] > t]
                        heapify(sets)
                        live = len(sets)
                    heappush(sets, (-idx, end, i, v))
                continue
            if t is not None and gone is not None and t < gone:
                continue
            while sets and sets[0][1] <= t:
                heappop(sets)
            at.append(i)
            is_set.append(bool(sets))
            values.append(sets[0][3] if sets else None)
        rows = batch["_row"].take(pa.array(at, "int64"))
        yield pa.RecordBatch.from_arrays([rows, pa.array(is_set, "bool"), pa.array(values, batch["_v"].type)], names=["_row", "_set", "_v"])
