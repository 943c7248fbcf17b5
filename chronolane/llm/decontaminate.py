"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

1. A document's window can only be as similar to an item as ``similarity`` asks if
   they share a shingle. So every shingle of every document meets the items'
   shingles, and each meeting proposes the window of the item's size that lines
   both up. Windows with equal content are then one.
2. Windows and items get 64-bit SimHash fingerprints. A multi-index of ``BLOCKS``
   blocks of bits finds every item of the window's size within ``radius`` bits:
   two such fingerprints differ in ``radius // BLOCKS`` bits at most in one block
   at least, and items are filed under all values so near to their own.
3. Weighted Jaccard similarity of the shingle bags (weight: how often a shingle
   occurs) decides.

The items' shingles are broadcast only below ``BROADCAST_ROWS`` rows, which are
counted first; a larger benchmark is joined by shuffles.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOC_ID, TEXT, texts, written

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 20
BROADCAST_ROWS = 200_000
#: Of 64 bits and a radius of 20: a window meets a tenth of the items of its size in each block, and an item is filed 46 to 56 times in each.
BLOCKS = 7


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words; empty with fewer words."""
    last = F.size(words) - width
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(hashes: Column) -> Column:
    """A bit is 1 if it is in over half the hashes."""

    def bit(acc: Column, b: Column) -> Column:
        ones = F.aggregate(
            hashes, F.lit(0), lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int")
        )
        return acc.bitwiseOR(F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def _edges() -> list[int]:
    return [64 * i // BLOCKS for i in range(BLOCKS + 1)]


def _blocks(fp: Column) -> Column:
    """The fingerprint's blocks of bits, each with its number."""
    edges = _edges()
    return F.array(
        *[
            F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("bits"))
            for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
        ]
    )


def _near_blocks(fp: Column, radius: int) -> Column:
    """For each block the values that differ from its own in ``radius // BLOCKS`` bits at most."""
    edges = _edges()

    def near(i: int, lo: int, hi: int) -> Column:
        flips = [sum(1 << b for b in bits) for n in range(radius // BLOCKS + 1) for bits in combinations(range(hi - lo), n)]
        own = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: F.struct(F.lit(i).alias("no"), own.bitwiseXOR(x).alias("bits")))

    return F.concat(*[near(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])


def _bag_overlap(a: Column, b: Column) -> Column:
    def count(bag: Column, x: Column) -> Column:
        return F.size(F.filter(bag, lambda y: y == x))

    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def contaminated(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_windows): each document that holds an item, with its most similar window.

    ``items``: item_id and text. Words are runs of letters and digits, lower
    case; an item of fewer words than ``width`` is one shingle; items without
    words and null texts match nothing. A document row that is repeated, and so
    each null doc_id, has rows of its own. Ties between windows go to the first.
    """
    parsed = items.select("item_id", _words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).where("size(w) > 0")
    parsed = parsed.select("item_id", F.size("w").alias("size"), F.least(F.size("w"), F.lit(width)).alias("k"), "w")
    widths = sorted(r["k"] for r in parsed.select("k").distinct().collect())  # `width` numbers at most
    parsed = parsed.withColumn(
        "bag", reduce(lambda c, k: c.when(F.col("k") == k, _shingles(F.col("w"), k)), widths, F.when(F.lit(False), F.array().cast("array<bigint>")))
    ).select("item_id", "size", "k", "bag")
    known = written(parsed.withColumn("fp", _fingerprint(F.col("bag"))))
    marks = known.select("k", "size", F.posexplode("bag").alias("offset", "shingle")).distinct()
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)

    keyed = texts(docs).withColumn("row_key", F.xxhash64(DOC_ID, TEXT))
    word_lists = keyed.select("row_key", _words(F.col(TEXT)).alias("w"))
    proposals = None
    for k in widths:
        seen = word_lists.select("row_key", F.posexplode(_shingles(F.col("w"), k)).alias("at", "shingle"))
        met = seen.join(marks.where(F.col("k") == k), "shingle").select(
            "row_key", F.greatest(F.col("at") - F.col("offset"), F.lit(0)).alias("start"), "size", "k"
        )
        proposals = met if proposals is None else proposals.union(met)
    if proposals is None:
        return keyed.limit(0).select(DOC_ID, F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word"), F.lit(0).cast("long").alias("n_windows"))
    by_row = written(proposals.groupBy("row_key").agg(F.collect_set(F.struct("start", "size", "k")).alias("asked")))
    cut = (
        by_row.join(keyed, "row_key")
        .select("row_key", "asked", _words(F.col(TEXT)).alias("w"))
        .select("row_key", "w", F.explode("asked").alias("q"))
        .select("row_key", "q.start", "q.size", "q.k", F.slice("w", F.col("q.start") + 1, F.col("q.size")).alias("part"))
    )
    bag = reduce(lambda c, k: c.when(F.col("k") == k, _shingles(F.col("part"), k)), widths, F.when(F.lit(False), F.array().cast("array<bigint>")))
    windows = written(
        cut.select("row_key", "start", "size", "k", bag.alias("bag"))
        .withColumn("content", F.xxhash64("bag", "size", "k"))
        .dropDuplicates(["row_key", "start", "size", "k"])
    )
    contents = windows.groupBy("content").agg(F.first("bag").alias("bag"), F.first("size").alias("size"), F.first("k").alias("k")).withColumn("fp", _fingerprint(F.col("bag")))
    mine = contents.select("content", "size", "k", "bag", "fp", F.explode(_blocks(F.col("fp"))).alias("block"))
    theirs = known.select(
        "item_id", "size", "k", F.col("bag").alias("item_bag"), F.col("fp").alias("item_fp"), F.explode(_near_blocks(F.col("fp"), radius)).alias("block")
    )
    near = (
        mine.join(theirs, ["size", "k", "block"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .dropDuplicates(["content", "item_id"])
    )
    common = _bag_overlap(F.col("bag"), F.col("item_bag"))
    verified = (
        near.withColumn("common", common)
        .withColumn("similarity", F.col("common") / (F.size("bag") + F.size("item_bag") - F.col("common")))
        .where(F.col("similarity") >= similarity)
        .select("content", "item_id", "similarity")
    )
    best = (
        windows.select("row_key", "start", "content")
        .join(verified, "content")
        .groupBy("row_key", "item_id")
        .agg(
            F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"),
            F.count_distinct("start").alias("n_windows"),
        )
    )
    rows = keyed.select(DOC_ID, "row_key")
    return rows.join(best, "row_key").select(
        DOC_ID, "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start_word"), "n_windows"
    )
