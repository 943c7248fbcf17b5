"""Shards cut from a Hilbert curve through the documents' metadata, in DataFrame functions only.

Size (its binary logarithm), source and language are quantised to ``BITS`` bits
each; the curve through that grid keeps neighbours in all three dimensions close
together, so a shard covers a small box and a reader can skip shards by any of
them. The law is ``rows``: the order is cut into runs whose counts are at most
one apart.

No row is ranked in one task: rows get their rank from the count of rows in the
cells before theirs (cells are hashed into ``SALTS`` parts, so that a hot cell is
many parts) plus their place in their own part. Only one row for each of at most
``GROUPS`` groups of cells is ever in a single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOC_ID, TEXT

DIMENSIONS, BITS = 3, 5
SALTS = 256
GROUPS = 1024


def _turned(x: int, by: int) -> int:
    by %= DIMENSIONS
    return ((x << by) | (x >> (DIMENSIONS - by))) & ((1 << DIMENSIONS) - 1)


def _step(state: int, corner: int) -> tuple[int, int]:
    """Which of the eight sub-cubes ``corner`` is along the curve in ``state`` (entry and direction), and the state inside it."""
    entry, direction = divmod(state, DIMENSIONS)
    gray = _turned(corner ^ entry, -(direction + 1))
    digit = reduce(lambda a, s: a ^ (gray >> s), range(1, DIMENSIONS), gray)
    before = 2 * ((digit - 1) // 2) if digit else 0
    entered = before ^ (before >> 1)
    ones = digit if digit % 2 else digit - 1
    run = 0 if digit == 0 else ((ones ^ (ones + 1)).bit_length() - 1)
    return digit, (entry ^ _turned(entered, direction + 1)) * DIMENSIONS + (direction + run + 1) % DIMENSIONS


_TABLE = [_step(s, c) for s in range(DIMENSIONS << DIMENSIONS) for c in range(1 << DIMENSIONS)]


def hilbert_index(*dims: Column) -> Column:
    """The place along the curve of a cell given by ``DIMENSIONS`` integers of ``BITS`` bits."""
    digits = F.array(*[F.lit(d) for d, _ in _TABLE])
    states = F.array(*[F.lit(s) for _, s in _TABLE])

    def walk(acc: Column, bit: Column) -> Column:
        corner = reduce(
            lambda a, b: a.bitwiseOR(b),
            [F.shiftleft(F.call_function("shiftright", d, bit).bitwiseAND(F.lit(1)), j) for j, d in enumerate(dims)],
        )
        at = acc["s"] * F.lit(1 << DIMENSIONS) + corner
        return F.struct((acc["h"] * F.lit(1 << DIMENSIONS) + F.get(digits, at)).alias("h"), F.get(states, at).alias("s"))

    start = F.struct(F.lit(0).alias("h"), F.lit(0).alias("s"))
    return F.aggregate(F.array(*[F.lit(b) for b in reversed(range(BITS))]), start, walk)["h"]


def _quantised(c: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(1 << BITS)).cast("int")


def shards(docs: DataFrame, n_shards: int = 40, grouping: tuple[str, str] = ("source", "lang")) -> DataFrame:
    """(doc_id, size, text_crc32, cell, shard, slot) for every row of ``docs``.

    size: UTF-8 bytes of the text plus 16. A null text counts as empty, nulls in
    the ``grouping`` columns as one more value. Shards are 0 to n_shards - 1,
    slots count from 0 in each, and shards' counts are at most one apart (with
    fewer rows than shards, some are empty). Rows that agree in all that is
    looked at are in no particular order. An empty table gives no rows.
    """
    text = F.coalesce(F.col(TEXT).cast("string"), F.lit(""))
    seen = docs.select(
        F.col(DOC_ID),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[_quantised(F.col(c)).alias(f"q{i}") for i, c in enumerate(grouping)],
    ).withColumn("q2", F.least(F.floor(F.log2("size")), F.lit((1 << BITS) - 1)).cast("int"))
    placed = seen.withColumn("cell", hilbert_index(F.col("q2"), F.col("q0"), F.col("q1"))).withColumn(
        "part", F.col("cell").cast("long") * SALTS + F.pmod(F.xxhash64(DOC_ID, "text_crc32"), F.lit(SALTS))
    )
    per_group = ((1 << (DIMENSIONS * BITS)) * SALTS) // GROUPS
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("grp", F.floor(F.col("part") / per_group))
    groups = counts.groupBy("grp").agg(F.sum("n").alias("n"))
    in_order = Window.orderBy("grp")  # GROUPS rows at most
    groups = groups.select(
        "grp",
        (F.sum("n").over(in_order) - F.col("n")).alias("before_group"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    in_group = Window.partitionBy("grp").orderBy("part")
    starts = (
        counts.withColumn("before", F.sum("n").over(in_group) - F.col("n"))
        .join(F.broadcast(groups), "grp")  # GROUPS rows at most
        .select("part", (F.col("before") + F.col("before_group")).alias("start"), "total")
    )
    own = Window.partitionBy("part").orderBy("size", "text_crc32", DOC_ID)
    ranked = placed.withColumn("place", F.row_number().over(own)).join(starts, "part").withColumn(
        "rank", F.col("start") + F.col("place") - 1
    )
    exact = F.expr(f"CAST((rank * {int(n_shards)}) DIV total AS INT)")
    first = F.expr(f"(shard * total + {int(n_shards)} - 1) DIV {int(n_shards)}")
    return ranked.withColumn("shard", exact).select(
        DOC_ID, "size", "text_crc32", "cell", "shard", (F.col("rank") - first).alias("slot")
    )
