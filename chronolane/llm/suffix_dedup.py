"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

Two strings of ``length`` bytes that are equal are sampled at one same offset:
the sampled positions of a string are chosen by content, the least hash among
``cover`` neighbouring starts. The texts become sequences of sampled positions;
the letter of one is the block of bytes that decides where the next one lies,
so comparing letter by letter is comparing byte by byte.

1. Sampled suffixes whose prefix (the bytes that all strings sampled there
   share) occurs once in the corpus are dropped: first the names alone are
   counted. Of suffixes with equal contexts (128-bit names) one goes on; the
   others are repeated as a whole.
2. ``suffix_ranks`` sorts what is left as the difference cover modulo 3 does:
   triples of letters at two of three places are sorted by range partitioning
   and named; while a name repeats whose triple is shorter than ``length``, the
   names are a shorter text that is sorted likewise; then the remaining third is
   merged in by (letter, rank of what follows).
3. Neighbours in that order compare their prefixes byte by byte, and neighbours
   in the order of the bytes before them, read backwards, compare those. That
   puts every start (the bytes between it and its sampled position, and from
   there on) into two classes; starts that agree in both are equal strings.
4. The starts found give spans, merged and cut from each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOC_ID, TEXT, forget, lean, texts, utf8, written

LENGTH = 400
#: At most so many starts share a sampled position, the one with the least hash of at most so many bytes.
COVER, GRAM = 160, 16
#: Two hashes of id and text name a row; equal rows have equal results.
ROW = ["row_a", "row_b"]
_BASE = 0x5851F42D4C957F2D
_LOW = np.uint64((1 << 24) - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Runs that cross edges of partitions, up to which their list is broadcast.
EDGES = 100_000
#: A reach beyond every text.
_FAR = 1 << 40


def sizes(length: int) -> tuple[int, int]:
    """For strings of ``length`` bytes: how many starts share a sampled position, and the bytes hashed there."""
    return max(1, min(COVER, 2 * length // 5)), max(1, min(GRAM, length // 8))


def letter_size(length: int) -> int:
    """Bytes of a letter: those that decide where the next sampled position lies, or more, so that most triples reach ``length`` bytes."""
    cover, gram = sizes(length)
    return max(cover + gram, length - cover // 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's last steps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Names:
    """Karp-Rabin names of the substrings of one text: ``of(start, length)``."""

    def __init__(self, data: bytes):
        n = len(data)
        up, self.down = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[np.frombuffer(data, np.uint8)] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mixed((self.sums[start + length] - self.sums[start]) * self.down[start])


def _sampled(names: Names, windows: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions a of the first ``windows`` starts, and the least and the greatest distance from them back to their starts."""
    cover, gram = sizes(length)
    n = windows + cover - 1
    sums, down = names.sums, names.down
    grams = (sums[gram : n + gram] - sums[:n]) * down[:n] * _FACTOR
    least = (grams & ~_LOW) | (_LOW - (np.arange(n, dtype=np.uint64) & _LOW))  # of equal grams the rightmost counts as least
    width = 1
    while width < cover:  # least of `width` neighbours, doubled until it is of `cover`
        step = min(width, cover - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    first = np.nonzero(np.concatenate([[True], least[1:] != least[:-1]]))[0]
    final = np.append(first[1:], windows) - 1
    low = (_LOW - (least[first] & _LOW)).astype(np.int64)
    at = first + ((low - first) & int(_LOW))
    return at, at - final, at - first


def _keyed(docs: DataFrame) -> DataFrame:
    named = texts(docs)
    return named.withColumn(ROW[0], F.xxhash64(DOC_ID, TEXT)).withColumn(ROW[1], F.xxhash64(F.lit("row"), DOC_ID, TEXT))


def _table(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in kinds.items()], names=[*kinds])


def _suffixes(keyed: DataFrame, length: int, names_only: bool) -> DataFrame:
    """k, the name of the prefix of each sampled suffix; then also f and g, names of its whole context, and where it is."""
    longs = ["k"] if names_only else ["k", "f", "g", *ROW]
    kinds = dict.fromkeys(longs, pa.int64()) | ({} if names_only else dict.fromkeys(["a", "low", "high"], pa.int32()))
    cover, _ = sizes(length)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in kinds]
            for text, *row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if len(data := utf8(text)) < length:
                    continue
                names = Names(data)
                at, low, high = _sampled(names, len(data) - length + 1, length)
                out[0].append(names.of(at, length - cover + 1).view(np.int64))
                if not names_only:
                    place = _mixed((low * COVER + high).astype(np.uint64) + np.uint64(1))
                    other = np.fromiter((xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip((at - high).tolist(), (at - low + length).tolist())), np.uint64, len(at))
                    columns = [(names.of(at - high, high - low + length) ^ place).view(np.int64), (other ^ place).view(np.int64)]
                    columns += [np.full(len(at), x) for x in row] + [x.astype(np.int32) for x in (at, low, high)]
                    for i, column in enumerate(columns):
                        out[i + 1].append(column)
            if out[0]:
                yield _table({c: np.concatenate(x) for c, x in zip(kinds, out)}, kinds)

    schema = ", ".join(f"{c} {'long' if t == pa.int64() else 'int'}" for c, t in kinds.items())
    return keyed.select(TEXT, *ROW).mapInArrow(run, schema)


def _pieces(found: DataFrame, length: int) -> DataFrame:
    """For each row's pieces, the union of the contexts of its suffixes: place i and letter (and 128 bits that name it) of every sampled position.

    Those that stand for starts have row, a, low, high, and the bytes after and before them (backwards). An empty letter ends a piece.
    """
    cover, gram = sizes(length)
    block = letter_size(length)
    kinds = {"seq": pa.int64(), "i": pa.int32(), "letter": pa.binary(), "l1": pa.int64(), "l2": pa.int64(), "at": pa.int64(), "reach": pa.int64()}
    kinds |= dict.fromkeys(ROW, pa.int64()) | dict.fromkeys(["a", "low", "high"], pa.int32()) | {"after": pa.binary(), "before": pa.binary()}

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, row_a, row_b, suffixes, seq in zip(*(batch.column(j).to_pylist() for j in range(5))):
                data = utf8(text)
                wanted = {s["a"]: (s["low"], s["high"]) for s in suffixes}
                spans = _merged([{"s": a - high, "e": a - low + length} for a, (low, high) in wanted.items()], data, False)
                rows: dict[str, list] = {c: [] for c in kinds}
                for s, e in spans:
                    at, _, _ = _sampled(Names(data[s:e]), e - s - cover - gram + 2, length)
                    for a in (at + s).tolist():
                        low, high = wanted.get(a, (None, None))
                        starts = low is not None
                        rows["letter"].append(data[a : min(a + block, e)])
                        rows["at"].append(a)
                        rows["reach"].append(a + block if a + block < e else _FAR)
                        rows["a"].append(a if starts else None)
                        rows["low"].append(low)
                        rows["high"].append(high)
                        rows["after"].append(data[a : min(a + length, e)] if starts else None)
                        rows["before"].append(data[max(s, a - cover) : a][::-1] if starts else None)
                    for c, x in (("letter", b""), ("at", e), ("reach", _FAR), *((c, None) for c in ("a", "low", "high", "after", "before"))):
                        rows[c].append(x)
                n = len(rows["at"])
                named = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, rows["letter"])), "<i8").reshape(-1, 2)
                rows |= {"l1": named[:, 0], "l2": named[:, 1]}
                rows |= {"seq": [seq] * n, "i": list(range(n)), ROW[0]: [row_a] * n, ROW[1]: [row_b] * n}
                for part in range(0, n, 4096):
                    yield _table({c: x[part : part + 4096] for c, x in rows.items()}, kinds)

    named = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return found.mapInArrow(run, ", ".join(f"{c} {named[t]}" for c, t in kinds.items()))


def places(rows: DataFrame, keys: list[str], sums: list[str], carried: list[str] = ()) -> DataFrame:
    """(keys, carried, sums, ``<sum>_before``): for each distinct key the total of columns ``sums`` at it and at all smaller keys.

    Keys are counted before they are shuffled, unless columns are ``carried``, which
    asks for distinct keys; then they are sorted by range partitioning, and one row
    for each partition tells how much the partitions before it hold.
    """
    grouped = rows.select(*keys, *carried, *sums) if carried else rows.groupBy(*keys).agg(*[F.sum(s).cast("long").alias(s) for s in sums])
    fixed = [*keys, *carried, *sums]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.schema.fields] + [f"{s}_here long" for s in sums] + ["part int"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = np.zeros(len(sums), np.int64)
        for batch in batches:
            columns = list(batch.columns)
            for j, s in enumerate(sums):
                own = batch.column(s).to_numpy()
                upto = np.cumsum(own) + held[j]
                columns.append(pa.array(upto - own))
                held[j] = upto[-1] if len(upto) else held[j]
            columns.append(pa.array(np.full(batch.num_rows, part, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[*fixed, *(f"{s}_here" for s in sums), "part"])

    local = written(grouped.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema))
    parts = local.groupBy("part").agg(*[F.sum(s).alias(s) for s in sums])  # a row for each partition
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", *[F.coalesce(F.sum(s).over(ahead), F.lit(0)).alias(f"{s}_ahead") for s in sums])
    return local.join(F.broadcast(offsets), "part").select(*fixed, *[(F.col(f"{s}_here") + F.col(f"{s}_ahead")).alias(f"{s}_before") for s in sums])


def suffix_ranks(rows: DataFrame, length: int) -> DataFrame:
    """(seq, i, rank) for the ``asked`` rows of ``rows`` (seq, i from 0, name, at, reach, asked): one more than how many asked suffixes are smaller.

    A suffix is the names of a sequence from place i on; a name stands for the
    bytes from ``at`` up to ``reach``. Suffixes that agree in ``length`` bytes may
    come in any order, or tie. Only sequences in which a triple that is shorter
    than that repeats are sorted again by their names.
    """
    along = Window.partitionBy("seq").orderBy("i")
    ahead = lambda c, n: F.lead(c, n, 0).over(along)
    behind = lambda n: F.coalesce(F.lag("asked", n).over(along), F.lit(False))
    reach = F.greatest("reach", ahead("reach", 1), ahead("reach", 2)).alias("reach")
    needed = (F.col("asked") | behind(1) | behind(2)).alias("needed")
    whole = written(rows.select("seq", "i", "name", ahead("name", 1).alias("name1"), ahead("name", 2).alias("name2"), "at", reach, "asked", needed))
    sampled, triple = whole.where("i % 3 <> 0"), ["name", "name1", "name2"]
    counted = places(sampled.select(*triple, F.lit(1).alias("n")), triple, ["n"])
    open_ = F.col("needed") & (F.col("n") > 1) & (F.col("name2") > 0) & (F.col("reach") - F.col("at") < length)
    named = written(sampled.join(counted, triple).select("seq", "i", (F.col("n_before") + 1).alias("name"), "at", "reach", "needed", open_.alias("open")))
    ranks = named.where("needed").select("seq", "i", F.col("name").alias("rank"))
    if named.where("open").isEmpty():
        ranks = ranks.withColumn("fine", F.lit(0).cast("long"))
    else:
        again = named.join(named.where("open").select("seq").distinct(), "seq", "left_semi")
        shorter = again.select((F.col("seq") * 2 + F.col("i") % 3 - 1).alias("seq"), F.expr("int(i div 3)").alias("i"), "name", "at", "reach", F.col("open").alias("asked"))
        deeper = suffix_ranks(shorter, length)
        deeper = deeper.select(F.expr("seq div 2").alias("seq"), F.expr("int(i * 3 + seq % 2 + 1)").alias("i"), F.col("rank").alias("fine"))
        ranks = ranks.join(deeper, ["seq", "i"], "left").withColumn("fine", F.coalesce("fine", F.lit(0).cast("long")))
    third = lambda n: (F.col("i") % 3 == n).cast("int")
    none = F.lit(0).cast("long")
    ranked = whole.where("needed").join(ranks, ["seq", "i"], "left").withColumns({"rank": F.coalesce("rank", none), "fine": F.coalesce("fine", none)})
    # The ranks of the two places after each; a place that is not the next one stands past the end.
    after = lambda c, n: F.when(F.lead("i", n).over(along) == F.col("i") + n, F.lead(c, n).over(along)).otherwise(none).alias(f"{c}{n}")
    merged = ranked.select("seq", "i", "name", "name1", "asked", "rank", "fine", *[after(c, n) for n in (1, 2) for c in ("rank", "fine")])
    merged = written(merged.where("asked").select("*", third(0).alias("left"), third(1).alias("one"), third(2).alias("two"), F.lit(1).alias("own")))
    by_one, by_two, by_own = ["name", "rank1", "fine1"], ["name", "name1", "rank2", "fine2"], ["rank", "fine"]
    first = places(merged.where("two = 0"), by_one, ["left", "one"]).select(*by_one, F.col("left_before").alias("left1"), F.col("one_before").alias("one1"))
    second = places(merged.where("one = 0"), by_two, ["left", "two"]).select(*by_two, F.col("left_before").alias("left2"), F.col("two_before").alias("two2"))
    third_ = places(merged.where("left = 0"), by_own, ["own"]).select(*by_own, "own_before")
    rank = F.when(F.col("one") == 1, F.col("own_before") + F.col("left1")).when(F.col("two") == 1, F.col("own_before") + F.col("left2")).otherwise(F.col("left1") + F.col("one1") + F.col("two2"))
    joined = merged.join(first, by_one, "left").join(second, by_two, "left").join(third_, by_own, "left")
    return written(joined.select("seq", "i", (rank + 1).alias("rank")))


def _common(a: bytes, b: bytes) -> int:
    """How many first bytes two strings share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _runs(heads: np.ndarray, least: int) -> list[dict]:
    """Runs of equal values, as depths from ``least`` on."""
    edges = [0, *(np.nonzero(heads[1:] != heads[:-1])[0] + 1).tolist(), len(heads)]
    return [{"head": int(heads[s]), "lo": least + s, "hi": least + e - 1} for s, e in zip(edges, edges[1:])]


def classes(rows: DataFrame, order: list[str], depth: int) -> DataFrame:
    """(seq, i, head, lo, hi): for the depths lo to hi, which rows have the same first bytes: those with the same head.

    ``rows``: seq, i, data, least, most (depths asked for) and the columns
    ``order``, which sort column data. Neighbours in that order are compared, also
    across partitions: each reports its first and last row, and heads that reach
    back over an edge are replaced by a join with one short list for each partition.
    """
    run_type = pa.struct([("head", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
    kinds = {"seq": pa.int64(), "i": pa.int32(), "runs": pa.list_(run_type), "part": pa.int32(), "first": pa.binary(), "last": pa.binary()}

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        n, first, last = part << 32, None, None
        heads = np.full(depth + 1, n)  # of every depth: the last row that differs from the one before it at that depth
        for batch in batches:
            runs = []
            for data, least, most in zip(*(batch.column(j).to_pylist() for j in (2, 3, 4))):
                if last is None:
                    first = data
                else:
                    heads[_common(last, data) + 1 :] = n
                runs.append(_runs(heads[least : most + 1], least))
                last, n = data, n + 1
            none = [None] * batch.num_rows
            yield _table({"seq": batch.column(0), "i": batch.column(1), "runs": runs, "part": none, "first": none, "last": none}, kinds)
        if last is not None:
            yield _table({"seq": [None], "i": [None], "runs": [_runs(heads, 0)], "part": [part], "first": [first], "last": [last]}, kinds)

    schema = "seq long, i int, runs array<struct<head: long, lo: int, hi: int>>, part int, first binary, last binary"
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("seq", "i", "data", "least", "most")
    local = written(sorted_.mapInArrow(run, schema))
    edges: list[tuple[int, int, int, int]] = []
    last, before = None, np.zeros(0)
    for r in local.where("part is not null").orderBy("part").collect():  # one row for each partition
        own = np.zeros(depth + 1, np.int64)
        for x in r["runs"]:
            own[x["lo"] : x["hi"] + 1] = x["head"]
        start = r["part"] << 32
        carried = np.full(depth + 1, start)
        if last is not None:
            upto = _common(last, bytes(r["first"])) + 1
            carried[:upto] = before[:upto]
            edges += [(start, x["head"], x["lo"], x["hi"]) for x in _runs(carried, 0) if x["head"] != start]
        last, before = bytes(r["last"]), np.where(own == start, carried, own)
    each = local.where("part is null").select("seq", "i", F.inline("runs"))
    if not edges:
        return each
    moved = rows.sparkSession.createDataFrame(edges, "start long, back long, from int, upto int")
    if len(edges) <= EDGES:
        moved = F.broadcast(moved)
    crossing = each.join(moved, F.col("head") == F.col("start"))
    meets = (F.col("from") <= F.col("hi")) & (F.col("upto") >= F.col("lo"))
    reached = crossing.where(meets).select("seq", "i", F.col("back").alias("head"), F.greatest("lo", "from").alias("lo"), F.least("hi", "upto").alias("hi"))
    # Depths are carried from 0 up to one depth, so what stays with a partition's first row is one run.
    tops = moved.groupBy("start").agg(F.max("upto").alias("top"))
    stays = each.join(tops, F.col("head") == F.col("start"), "left").where("top is null or hi > top")
    kept = stays.select("seq", "i", "head", F.when(F.col("top").isNull(), F.col("lo")).otherwise(F.greatest("lo", F.col("top") + 1)).alias("lo"), "hi")
    return reached.union(kept)


def _merged(spans: list[dict], data: bytes, whole_chars: bool) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in (() if spans is None else spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    if whole_chars:
        for span in out:
            while span[0] < span[1] and data[span[0]] & 0xC0 == 0x80:
                span[0] += 1
            while span[1] > span[0] and span[1] < len(data) and data[span[1]] & 0xC0 == 0x80:
                span[1] -= 1
    return [(s, e) for s, e in out if s < e]


def _equal_starts(pieces: DataFrame, length: int) -> DataFrame:
    """(row_a, row_b, s, e): for each sampled suffix that stands for starts, the bytes of those whose strings occur twice."""
    letters = pieces.groupBy("l1", "l2").agg(F.first("letter").alias("letter"), F.lit(1).alias("n"))
    letters = places(letters, ["letter"], ["n"], ["l1", "l2"]).select("l1", "l2", (F.col("n_before") + 1).alias("name"))
    spelt = pieces.select("seq", "i", "l1", "l2", "at", "reach", F.col("a").isNotNull().alias("asked")).join(letters, ["l1", "l2"])
    ranks = suffix_ranks(spelt.drop("l1", "l2"), length)
    asked = pieces.where("a is not null")
    after = asked.join(ranks, ["seq", "i"]).select("seq", "i", F.col("after").alias("data"), (length - F.col("high")).alias("least"), (length - F.col("low")).alias("most"), "rank")
    before = asked.select("seq", "i", F.col("before").alias("data"), F.col("low").alias("least"), F.col("high").alias("most"))
    right = classes(after, ["rank", "seq", "i"], length).select("seq", "i", F.col("head").alias("right"), (length - F.col("hi")).alias("lo"), (length - F.col("lo")).alias("hi"))
    left = classes(before, ["data", "seq", "i"], sizes(length)[0]).select("seq", "i", F.col("head").alias("left"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = left.join(right, ["seq", "i"]).select("seq", "i", "left", "right", F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi")).where("lo <= hi")
    both = written(both)
    # At most `cover` squared different ranges lo to hi for a pair of classes, however many suffixes share them.
    ranges = both.groupBy("left", "right", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    shared = ranges.groupBy("left", "right").agg(F.collect_list(F.struct("lo", "hi", "n")).alias("ranges"), F.min("lo").alias("least"), F.max("hi").alias("most"), F.sum("n").alias("n")).where("n > 1")

    def times(d: Column) -> Column:
        return F.aggregate("ranges", F.lit(0).cast("long"), lambda n, x: n + F.when((x["lo"] <= d) & (x["hi"] >= d), x["n"]).otherwise(0))

    twice = shared.select("left", "right", F.filter(F.sequence("least", "most"), lambda d: times(d) > 1).alias("twice")).where("size(twice) > 0")
    own = F.filter("twice", lambda d: (d >= F.col("lo")) & (d <= F.col("hi")))
    found = both.join(twice, ["left", "right"]).select("seq", "i", F.array_min(own).alias("d"), F.array_max(own).alias("far")).where("d is not null")
    # Starts that share a sampled position lie within `length` bytes, so what lies between two of them is covered.
    return asked.join(found, ["seq", "i"]).select(*ROW, (F.col("a") - F.col("far")).alias("s"), (F.col("a") - F.col("d") + length).alias("e"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """The rows with their keys, and (row_a, row_b, found): for each row that repeats something, unmerged byte spans (s, e)."""
    if length < 1:
        raise ValueError("length must be 1 or more")
    keyed = _keyed(docs)
    counted = _suffixes(keyed, length, True).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    counted = written(counted)  # both sides of the join are then plain exchanges, which the adaptive skew join can split
    shared = written(_suffixes(keyed, length, False).join(counted, "k"))
    context = ["k", "f", "g"]
    contexts = written(shared.groupBy(*context).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ROW, "a", "low", "high")).alias("rep")))
    whole = shared.join(contexts.where("n > 1").select(*context), context).select(
        *ROW, (F.col("a") - F.col("high")).alias("s"), (F.col("a") - F.col("low") + length).alias("e")
    )
    mixed = written(contexts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"))
    lists = contexts.join(mixed, "k").select("rep.*").groupBy(*ROW).agg(F.collect_list(F.struct("a", "low", "high")).alias("suffixes"))
    once = keyed.join(lists, ROW).dropDuplicates(ROW)
    pieces = written(_pieces(once.select(TEXT, *ROW, "suffixes", F.monotonically_increasing_id().alias("seq")), length))
    parts = _equal_starts(pieces, length)
    spans = written(whole.union(parts).groupBy(*ROW).agg(F.collect_list(F.struct("s", "e")).alias("found")))
    for used in (counted, shared, contexts, mixed, pieces):
        forget(used)
    return keyed, spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, whole_chars: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<s,e>>, kept binary) for every row of ``docs``: its size, what goes, what stays.

    Each byte covered by a ``length``-byte string (1 or more) that also starts
    anywhere else in the input (the same text included) is removed; strings are
    judged on the input. A null text is read as empty; texts shorter than
    ``length`` are kept whole; rows repeated in full repeat each other.
    ``whole_chars`` keeps a character of which only a part would go, so that
    ``kept`` stays UTF-8.
    """
    keyed, spans = repeated_spans(docs, length)
    kind = keyed.schema[DOC_ID].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("s", pa.int32()), ("e", pa.int32())])
        for batch in batches:
            sizes_, merged, kept = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = utf8(text)
                own = _merged(found, data, whole_chars)
                sizes_.append(len(data))
                merged.append([{"s": s, "e": e} for s, e in own])
                kept.append(_outside(data, own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes_, pa.int64()), pa.array(merged, pa.list_(span)), pa.array(kept, pa.binary())],
                names=[DOC_ID, "n_bytes", "spans", "kept"],
            )

    return keyed.join(spans, ROW, "left").select(DOC_ID, TEXT, "found").mapInArrow(run, f"{DOC_ID} {kind}, n_bytes long, spans array<struct<s:int,e:int>>, kept binary")


def _outside(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s_e in spans for x in s_e), len(data)]
    return b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2]))


def cut_texts(docs: DataFrame, length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """``docs`` with the same columns, repeats removed from column text (whole characters only) and n_chars, if there is one, set anew.

    A run of repeated bytes goes if it has ``least_words`` words or more (parted by
    white space; a cut word counts). Null texts stay null.
    """
    keyed, spans = repeated_spans(docs, length)
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # whatever the columns are called, they can't clash
    whole = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    row = [F.col(named[DOC_ID]), F.coalesce(F.col(named[TEXT]).cast("string"), F.lit(""))]

    @F.pandas_udf("string")
    def cut(texts_: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts_, found):
            if text is None or own is None or not len(own):
                out.append(text)
                continue
            data = utf8(text)
            spans_ = [(s, e) for s, e in _merged(own, data, True) if len(data[s:e].split()) >= least_words]
            out.append(_outside(data, spans_).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    joined = whole.withColumn(ROW[0], F.xxhash64(*row)).withColumn(ROW[1], F.xxhash64(F.lit("row"), *row)).join(spans, ROW, "left")
    done = joined.withColumn(named[TEXT], cut(named[TEXT], "found"))
    if "n_chars" in named:
        done = done.withColumn(named["n_chars"], F.length(named[TEXT]).cast("long"))
    return done.select(*[F.col(n).alias(c) for c, n in named.items()])
