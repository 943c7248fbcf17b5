"""Exact k-means against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from chronolane.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, x string, cluster string, distance double"


def brute(rows, k, rounds, dims, seed=3):
    whole = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [(n * 1024) // d for n, d in (x.as_integer_ratio() for x in v)]) for i, v in whole]

    def first(row):
        i, v = row
        return (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v)

    centres = [v for _, v in sorted(kept, key=first)[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((i, d.index(min(d)), min(d), v))
        return out

    for _ in range(rounds):
        now = assign()
        for n in range(len(centres)):
            own = [v for _, c, _, v in now if c == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    last, top = assign(), (1 << 63) - 1
    sums = [sum(d for _, c, d, _ in last if c == n) for n in range(len(centres))]
    return [
        (i, c, min(d, top), min(sums[c], top), min(sum(sums), top), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d, _ in last
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "c", 0.5) for i, v in rows], SCHEMA)


def same(spark, rows, k=4, rounds=4, dims=3):
    got = [tuple(r) for r in centroids.cluster(frame(spark, rows).repartition(3), k, rounds, dims).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, k, rounds, dims)))
    return got


def test_equals_brute_force_with_nulls_ties_and_repeats(spark):
    rnd = random.Random(5)
    rows = [(i, [round(rnd.gauss(rnd.choice([-1, 0, 2]), 0.2), 3) for _ in range(3)]) for i in range(120)]
    rows += [rows[0]] * 40 + [(None, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5])]
    rows += [(200, None), (201, [1.0, 2.0]), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [float("inf"), 0.0, 0.0]), (205, [])]
    got = same(spark, rows)
    assert len(got) == 162


def test_large_components_stay_exact(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.uniform(-1, 1) * 10.0 ** rnd.choice([0, 4, 6, 30, 300, 308]) for _ in range(3)]) for i in range(60)]
    same(spark, rows, k=5, rounds=3)


def test_few_rows_and_no_rows(spark):
    same(spark, [(1, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])], k=8)
    assert centroids.cluster(frame(spark, []), 8, 2, 3).collect() == []
    assert centroids.cluster(frame(spark, [(1, None)]), 8, 2, 3).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("top", [2.0**20, 2.0**24, 2.0**26.4, 2.0**30, 2.0**40])
def test_each_arithmetic_gives_the_same(top):
    rnd = np.random.default_rng(1)
    x = np.floor(rnd.uniform(-top, top, (50, 64)))
    centres = [[int(v) for v in row] for row in np.floor(rnd.uniform(-top, top, (4, 64)))]
    cluster, distance = centroids.nearest(x, np.abs(x).max(axis=1), x / 1024, centres)
    for row, c, d in zip(x, cluster, distance):
        all_ = [sum((int(a) - b) ** 2 for a, b in zip(row, own)) for own in centres]
        assert (all_.index(min(all_)), min(all_)) == (c, d)
