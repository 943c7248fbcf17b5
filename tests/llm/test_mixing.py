"""The mix: targets against resharing step by step, draws against a plain loop, the tree's sums and its distribution."""

import random
import re
import struct
from collections import Counter, defaultdict
from math import comb

import pytest
import xxhash
from pyspark.sql import functions as F

from chronolane.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, part int, key string, rank double"


def hashed(*of):
    """Spark's xxhash64: each value is hashed with the hash so far as its seed; a null changes nothing."""
    h = 42
    for kind, v in of:
        if v is not None:
            h = xxhash.xxh64(struct.pack("<" + kind, v), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def permuted(x, n, *key):
    for i in range(1, mixing.ROUNDS + 1):
        partner = (hashed(*key, ("i", i)) - x) % n
        if hashed(*key, ("i", -1), ("i", i), ("q", max(x, partner))) & 1:
            x = partner
    return x


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def reshared(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        base = sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / base for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def taken(docs, block, seed=0):
    """What each row is taken for, block by block."""
    rows = [(d, s, words(t)) for d, t, s in docs]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    target, out = reshared(sizes), Counter()
    for rank, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode()))):
        own = [(d, n) for d, t, n in rows if t == s]
        part = lambda r: hashed(("i", seed), ("q", r[0]), ("q", r[1])) % mixing.PARTS
        own.sort(key=lambda r: (part(r), hashed(("i", seed + 1), ("q", r[0]), ("q", r[1])), r[0] is not None, r[0] or 0, r[1]))
        stream = [r for r in own for _ in range(r[1])]
        n_blocks = -(-len(stream) // block)
        left, turn = min(round(target[s]), 3 * sizes[s]), 0
        while left > 0:
            order = sorted(range(n_blocks), key=lambda b: permuted(b, n_blocks, ("i", seed), ("i", rank), ("q", turn)))
            for b in order:
                piece = stream[b * block : (b + 1) * block][:left]
                left -= len(piece)
                out.update((d, s, n) for d, n in piece)
            turn += 1
    return out, target, sizes


def documents(seed=1, n=150):
    rnd = random.Random(seed)
    out = [(i, " ".join("w" * rnd.randint(1, 4) for _ in range(rnd.choice([0, 1, 7, 30, 90]))), rnd.choice(["hot"] * 6 + ["a", "b", "B", "é", "", None, "z"])) for i in range(n)]
    out += [(None, "no id", "hot"), (None, None, None), (n, None, "a"), (n + 1, " \t\n", "b"), (n + 2, "x\x0by z\x0c", "b"), (n + 3, "long " * 40_000, "long"), (n + 4, "tiny", "t"), (n + 5, None, "none")]
    return out + [out[3]] * 9


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(d, t, s, "x", 1, "k", 0.5) for d, t, s in docs], SCHEMA).repartition(parts)


def test_equals_a_loop_over_blocks(spark):
    docs, block = documents(), 16
    want, target, sizes = taken(docs, block)
    got = [(r["doc_id"], r["source"], r["size"], r["source_size"], r["target"], sum(x["end_word"] - x["first_word"] for x in r["pieces"])) for r in mixing.placed(frame(spark, docs), 5, block).collect()]
    assert len(got) == len(docs)
    sums, rows = Counter(), Counter()
    for d, s, n, source_size, goal, t in got:
        assert n * 3 >= t and source_size == sizes[s] and goal == pytest.approx(target[s])
        sums[s] += t
        rows[d, s, n] += t
    assert {k: v for k, v in rows.items() if v} == dict(want)
    assert all(sums[s] == min(round(target[s]), 3 * sizes[s]) for s in sizes)


def test_shards_hold_disjoint_blocks_and_reruns_agree(spark):
    docs = documents(2)
    one = sorted(map(repr, mixing.mix(frame(spark, docs), 6, 32, 7).collect()))
    assert one == sorted(map(repr, mixing.mix(frame(spark, docs[::-1], 7), 6, 32, 7).collect()))
    where, counts = {}, Counter()
    for r in mixing.mix(frame(spark, docs), 6, 32, 7).collect():
        key = (r["source"], r["pass"], r["block"])
        assert where.setdefault(key, (r["shard"], r["place"])) == (r["shard"], r["place"])
    counts.update(shard for shard, _ in where.values())
    assert set(counts) == set(range(6)) and max(counts.values()) - min(counts.values()) <= 1


def test_empty_table_and_table_without_words(spark):
    assert mixing.placed(frame(spark, [])).collect() == []
    rows = mixing.placed(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["target"], r["pieces"]) for r in rows] == [(0.0, []), (0.0, [])]


def test_permutations_are_whole_and_differ(spark):
    df = spark.range(97).select("id", *[mixing.permuted(F.col("id"), F.lit(97).cast("long"), F.lit(k)).alias(f"p{k}") for k in range(3)])
    rows = df.collect()
    for k in range(3):
        assert sorted(r[f"p{k}"] for r in rows) == list(range(97))
    assert len({tuple(r[f"p{k}"] for r in rows) for k in range(3)}) == 3


def test_draws_are_hypergeometric(spark):
    n, whole, own, draws = 4000, 20, 8, 9
    long = lambda x: F.lit(x).cast("long")
    u = (F.col("id") + 0.5) / n
    got = Counter(r["x"] for r in spark.range(n).select(mixing.hypergeometric(long(whole), long(own), long(draws), u).alias("x")).collect())
    for x in range(0, 9):
        assert got[x] == pytest.approx(n * comb(8, x) * comb(12, 9 - x) / comb(20, 9), abs=1.5)
    edges = [(10, 0, 5, 0), (10, 10, 5, 5), (10, 7, 10, 7), (0, 0, 0, 0), (10, 9, 9, None), (10**10, 3 * 10**9, 5 * 10**9, None)]
    for w, o, d, want in edges:
        x = spark.range(1).select(mixing.hypergeometric(long(w), long(o), long(d), F.lit(0.3)).alias("x")).first()["x"]
        assert x == want if want is not None else max(0, d - w + o) <= x <= min(d, o)


def test_sums_of_the_tree_are_exact(spark):
    rows = spark.createDataFrame([([5, 0, 17, 1000], [200, 300, 22, 500, 0, 0, 0, 0])], "c array<long>, r array<long>")
    dealt = mixing.split(rows, "c", "r", 5, F.lit(1)).first()["dealt"]
    assert [sum(x) for x in dealt] == [200, 300, 22, 500, 0, 0, 0, 0] and [sum(x) for x in zip(*dealt)] == [5, 0, 17, 1000]
