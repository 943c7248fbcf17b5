"""A mix of sources in exact proportions, dealt out to shards, in DataFrame functions only.

Each source is one stream of words, its documents in hashed order, cut into blocks of
``block_words``. A source's target in words is met exactly: it is so many whole
passes over its blocks, and of one more pass the first so many words in permuted
order (the last block drawn is cut). A pass permutes blocks by a keyed
swap-or-not shuffle (Hoang, Morris and Rogaway 2012), so the draw of any block is
computed where its document is; no table of blocks is sorted.

How many draws of each source a shard gets comes from a splitting tree: all draws
are halved again and again, each half's counts drawn from the multivariate
hypergeometric distribution (source after source, by inversion), as if all
blocks had been shuffled as one. The draws of a source then go to the shards in
order of their numbers, so blocks are disjoint. Inside a shard ``place`` is a hash to
sort by.

Documents lie in ``PARTS`` parts of each source, by hash: a running sum stays inside
one part, and one row for each part gives what lies before it. So a hot source is as
many tasks as others. What one task gets whole is one row for each source (ranks
and targets) and, in the tree, arrays of at most the root of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOC_ID, TEXT, written

WEIGHTS = (5, 2, 1)
#: No document, and so no source, is taken more often.
MOST = 3
PARTS = 4096
ROUNDS = 48
WORD = r"[^\x20\x09-\x0D]+"


def _uniform(*of) -> Column:
    """A number in [0, 1) that follows from ``of``."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / F.lit(float(1 << 53))


def permuted(x: Column, n: Column, *key) -> Column:
    """Where ``x`` of 0 .. n - 1 goes in a permutation that ``key`` chooses."""

    def step(at: Column, i: Column) -> Column:
        partner = F.pmod(F.xxhash64(*key, i) - at, n)
        swap = F.xxhash64(*key, F.lit(-1), i, F.greatest(at, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def hypergeometric(whole: Column, own: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` without replacement out of ``whole`` are among ``own`` of them, by inversion of ``u``.

    Weights run over nine deviations (and nine more) around the mean; what lies
    beyond is less than a double can tell from nothing.
    """
    least, most = F.greatest(F.lit(0).cast("long"), draws - whole + own), F.least(draws, own)
    n, k, d = (c.cast("double") for c in (whole, own, draws))
    mean = d * k / F.greatest(n, F.lit(1.0))
    spread = 9 * F.sqrt(F.greatest(mean * (1 - k / F.greatest(n, F.lit(1.0))) * (n - d) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0))) + 9
    low = F.greatest(least, F.floor(mean - spread).cast("long"))
    high = F.greatest(low, F.least(most, F.ceil(mean + spread).cast("long")))

    def next_weight(w: Column, x: Column) -> Column:
        return w * (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))

    def summed(a: Column, x: Column) -> Column:
        return F.struct(next_weight(a["w"], x).alias("w"), (a["s"] + a["w"]).alias("s"))

    def chosen(u_total: Column):
        def step(a: Column, x: Column) -> Column:
            s = a["s"] + a["w"]
            return F.struct(next_weight(a["w"], x).alias("w"), s.alias("s"), F.coalesce(a["x"], F.when(s > u_total, x)).alias("x"))

        return step

    def found(span: Column) -> Column:
        total = F.aggregate(span, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")), summed, lambda a: a["s"])
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(None).cast("long").alias("x"))
        return F.get(F.transform(F.array(total), lambda t: F.aggregate(span, start, chosen(u * t), lambda a: F.coalesce(a["x"], F.array_max(span)))), F.lit(0))

    return F.when(least >= most, most).otherwise(F.get(F.transform(F.array(F.sequence(low, high)), found), F.lit(0)))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _left(counts: Column, draws: Column, *key) -> Column:
    """Of ``counts`` of each kind, how many fall into the half that gets ``draws`` of them all."""

    def step(acc: Column, own: Column) -> Column:
        x = hypergeometric(acc["whole"], own, acc["draws"], _uniform(*key, F.size(acc["out"])))
        return F.get(F.transform(F.array(x), lambda got: F.struct((acc["whole"] - own).alias("whole"), (acc["draws"] - got).alias("draws"), F.concat(acc["out"], F.array(got)).alias("out"))), F.lit(0))

    start = F.struct(_total(counts).alias("whole"), draws.cast("long").alias("draws"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(counts, start, step, lambda a: a["out"])


def split(rows: DataFrame, counts: str, room: str, n_shards: int, *key) -> DataFrame:
    """``rows`` with ``dealt``: for each shard the counts of each kind, in sums ``counts`` by kind and ``room`` by shard exactly.

    ``room`` holds a power of two of numbers, zeros behind those of the ``n_shards``.
    """

    def halves(half: int):
        def split_one(own: Column, i: Column) -> Column:
            draws = _total(F.slice(F.col(room), i * (2 * half) + 1, F.lit(half)))
            left = _left(own, draws, *key, F.lit(half), i)
            return F.get(F.transform(F.array(left), lambda x: F.array(x, F.zip_with(own, x, lambda a, b: a - b))), F.lit(0))

        return split_one

    out = rows.withColumn("dealt", F.array(F.col(counts)))
    half = (1 << (n_shards - 1).bit_length()) // 2
    while half:
        out, half = out.withColumn("dealt", F.flatten(F.transform("dealt", halves(half)))), half // 2
    return out


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size) with rank, weight and target: shares of the whole by weight, none above ``MOST`` times its size.

    Sources are ranked by code point, null last, and weigh 5, 2, 1, repeating. The
    excess of those at their limit is shared by weight: limits are met in order of
    limit for weight, and the level of the others is the highest that a prefix of
    that order leaves.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = ranked.withColumns({"weight": F.get(F.array(*map(F.lit, WEIGHTS)), F.col("rank") % len(WEIGHTS)), "limit": (MOST * F.col("source_size")).cast("double")})
    before = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    return level.withColumn("target", F.least("limit", F.max("level").over(everything) * F.col("weight"))).drop("level", "limit")


def _quotas(sources: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Sources with their blocks, whole passes, words of the last pass, the last block's draw in it, and draws in all."""
    b, size = F.lit(block_words), F.col("source_size")
    words = F.least(F.round("target").cast("long"), MOST * size)
    made = sources.withColumns({"words": words, "blocks": F.ceil(size / b).cast("long")})
    made = made.withColumns(
        {
            "passes": F.when(size > 0, F.floor(F.col("words") / size)).otherwise(0).cast("long"),
            "last_words": F.when(size > 0, size - (F.col("blocks") - 1) * b).otherwise(0).cast("long"),
        }
    ).withColumn("rest", F.col("words") - F.col("passes") * size)
    rho = permuted(F.col("blocks") - 1, F.greatest("blocks", F.lit(1).cast("long")), F.lit(seed), "rank", "passes")
    made = made.withColumn("last_draw", F.when(F.col("blocks") > 0, rho))
    upto = F.col("last_draw") * b
    more = (
        F.when(F.col("rest") <= 0, 0)
        .when(F.col("rest") <= upto, F.ceil(F.col("rest") / b))
        .when(F.col("rest") <= upto + F.col("last_words"), F.col("last_draw") + 1)
        .otherwise(F.ceil((F.col("rest") + b - F.col("last_words")) / b))
    )
    return made.withColumn("draws", F.col("passes") * F.col("blocks") + more.cast("long"))


def _dealt(sources: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """Sources with ``begins``: the number of a source's first draw in each shard."""
    leaves = 1 << (n_shards - 1).bit_length()
    width = F.ceil(F.sqrt(F.count(F.lit(1)).over(Window.partitionBy()))).cast("long")
    grouped = sources.withColumn("_group", F.floor(F.col("rank") / width))
    own = F.array_sort(F.collect_list(F.struct("rank", "draws")))
    groups = grouped.groupBy("_group").agg(own.alias("members")).withColumn("counts", F.transform("members", lambda x: x["draws"]))
    top = groups.agg(F.array_sort(F.collect_list(F.struct("_group", _total(F.col("counts")).alias("n")))).alias("g"))
    total = _total(F.transform("g", lambda x: x["n"]))
    room = F.transform(
        F.sequence(F.lit(0), F.lit(leaves - 1)),
        lambda i: F.when(i < n_shards, F.floor((i + 1) * F.col("total") / n_shards) - F.floor(i * F.col("total") / n_shards)).otherwise(0).cast("long"),
    )
    top = top.select("g", F.transform("g", lambda x: x["n"]).alias("counts"), total.alias("total")).withColumn("room", room)
    shared = split(top, "counts", "room", n_shards, F.lit(seed), F.lit("groups"))
    each = shared.select(F.posexplode("g").alias("_at", "own"), "dealt").select(F.col("own._group").alias("_group"), F.transform("dealt", lambda x: F.get(x, F.col("_at"))).alias("room"))
    inner = split(groups.join(each, "_group"), "counts", "room", n_shards, F.lit(seed), F.col("_group"))
    one = inner.select(F.posexplode("members").alias("_at", "own"), "dealt").select(F.col("own.rank").alias("rank"), F.transform("dealt", lambda x: F.get(x, F.col("_at"))).alias("n"))
    begins = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda i: _total(F.slice("n", F.lit(1), i - 1)))
    return sources.join(one.select("rank", begins.alias("begins")), "rank")


def placed(docs: DataFrame, n_shards: int = 32, block_words: int = 1024, seed: int = 0) -> DataFrame:
    """Every row of ``docs`` with what the mix takes of it: (doc_id, source, size, source_size, target, pieces).

    size: the words of the text (runs of other characters than space and U+0009 to
    U+000D); a null text has none. ``pieces``: structs (shard, place, pass, block,
    first_word, end_word), half-open, words counted in the document. A null source is
    a source of its own, the last; null and repeated ids are rows like any others, and
    rows alike in id, source and size are interchangeable. An empty table gives no
    rows, sources without words get none and have a target of 0. Columns of other
    names are not looked at. Reruns agree, however the table is dealt out.
    """
    text = F.coalesce(F.col(TEXT).cast("string"), F.lit(""))
    seen = docs.select(F.col(DOC_ID), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    # Rows that are alike become one, before a shuffle meets them.
    sized = written(seen.groupBy(DOC_ID, "source", "size").agg(F.count(F.lit(1)).alias("alike")))
    words = F.col("size") * F.col("alike")
    quotas = _quotas(targets(sized.groupBy("source").agg(F.sum(words).alias("source_size"))), block_words, seed)
    sources = written(_dealt(written(quotas), n_shards, seed).drop("weight", "words"))
    part = F.pmod(F.xxhash64(F.lit(seed), DOC_ID, "size"), F.lit(PARTS)).cast("int")
    # A key without nulls, for joins.
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key")
    rows = sized.select("*", key, part.alias("part"))
    sums = rows.groupBy("key", "part").agg(F.sum(words).alias("_words"))
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("key", "part", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_before")).join(sources.select(key, *[c for c in sources.columns if c != "source"]), "key")
    inside = Window.partitionBy("key", "part").orderBy(F.xxhash64(F.lit(seed + 1), DOC_ID, "size"), DOC_ID, "size").rowsBetween(Window.unboundedPreceding, -1)
    lying = rows.withColumn("_start", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(parts, ["key", "part"])
    each = lying.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1)).alias("_copy"))
    each = each.withColumn("begin", F.col("_before") + F.col("_start") + F.col("_copy") * F.col("size"))
    return each.select(DOC_ID, "source", "size", "source_size", "target", _pieces(block_words, seed).alias("pieces"))


def _pieces(block_words: int, seed: int) -> Column:
    b, size, begin = F.lit(block_words), F.col("size"), F.col("begin")
    last = F.col("blocks") - 1

    def draw(block: Column, turn: Column) -> Column:
        """One block in one pass: its draw, how many of its words are taken, and which of them are the document's."""
        rho = permuted(block, F.col("blocks"), F.lit(seed), "rank", turn)

        def piece(at: Column) -> Column:
            whole = F.when(block == last, F.col("last_words")).otherwise(b)
            starts = at * b - F.when(F.col("last_draw") < at, b - F.col("last_words")).otherwise(0)
            taken = F.when(turn < F.col("passes"), whole).otherwise(F.greatest(F.lit(0).cast("long"), F.least(whole, F.col("rest") - starts)))
            number = turn * F.col("blocks") + at
            shard = F.size(F.filter("begins", lambda x: x <= number)) - 1
            return F.struct(
                shard.alias("shard"),
                F.xxhash64(F.lit(seed), F.lit("place"), shard, F.col("rank"), number).alias("place"),
                turn.cast("int").alias("pass"),
                block.alias("block"),
                F.greatest(block * b - begin, F.lit(0).cast("long")).alias("first_word"),
                F.least(block * b + taken - begin, size).alias("end_word"),
            )

        return F.get(F.transform(F.array(rho), piece), F.lit(0))

    first = F.floor(begin / b).cast("long")
    blocks = F.when(size > 0, F.sequence(first, F.floor((begin + size - 1) / b).cast("long"))).otherwise(F.array().cast("array<long>"))
    turns = F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1))
    turns = F.when((F.col("passes") > 0) | (F.col("rest") > 0), turns).otherwise(F.array().cast("array<long>"))
    all_ = F.flatten(F.transform(blocks, lambda k: F.transform(turns, lambda e: draw(k, e))))
    return F.filter(all_, lambda x: x["end_word"] > x["first_word"])


def mix(docs: DataFrame, n_shards: int = 32, block_words: int = 1024, seed: int = 0) -> DataFrame:
    """(shard, place, source, pass, block, doc_id, first_word, end_word): the mix, a row for each stretch of a document in a drawn block.

    A shard is read in order of (place, first_word of its documents in the stream):
    whole blocks in hashed order. Shards hold numbers of blocks at most one apart.
    """
    return placed(docs, n_shards, block_words, seed).select(DOC_ID, "source", F.explode("pieces").alias("x")).select(
        "x.shard", "x.place", "source", "x.pass", "x.block", DOC_ID, "x.first_word", "x.end_word"
    )
