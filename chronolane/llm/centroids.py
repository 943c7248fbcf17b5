"""Exact k-means on integer vectors: distances by a matrix product in floats, sums by ``treeAggregate``.

Vectors become integers, floor(scale * x). A block of rows meets all centroids in
one product, |x|^2 - 2 x.c + |c|^2, in float64. Every number in it is an integer
of at most 64 (max|x| + max|c|)^2 (for 64 components); while that is below 2^53
each sum is exact in any order. Rows beyond that bound are computed with 64-bit
integers, and beyond their bound with Python's, so no row is approximated.

A round is one pass over the table: partitions sum their own vectors, an RDD
``treeAggregate`` adds the sums of partitions (a few numbers for each cluster), and
the driver gets those alone. Nothing is shuffled by cluster, so a cluster that
holds most of the rows is like any other.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID, VECTOR = "vec_id", "embedding"
SCALE = 1024
#: Rows of one matrix product.
BLOCK = 4096
LONG = (1 << 63) - 1


def kept(vectors: DataFrame, dims: int, id_col: str = ID, vector_col: str = VECTOR) -> DataFrame:
    """(vec_id, x): vectors with exactly ``dims`` components, none null, NaN or infinite, as doubles."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where((F.size(x) == dims) & whole).select(F.col(id_col).alias(ID), x.alias("x"))


def _integers(x: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) as float64, which holds it exactly, and each row's greatest magnitude."""
    flat = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore"):
        out = np.floor(flat * float(SCALE))
    # Only components over 2^1013 overflow here; they are redone below as Python integers.
    return out, np.abs(out).max(axis=1, initial=0.0)


def _python(row: np.ndarray) -> list[int]:
    """One row of components, before scaling, as exact integers."""
    return [(n * SCALE) // d for n, d in (float(v).as_integer_ratio() for v in row)]


def nearest(x: np.ndarray, most: np.ndarray, raw: np.ndarray, centres: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Cluster and squared distance of each row of one block; ``raw``: the components before scaling."""
    dims, top = x.shape[1], min(max((abs(v) for c in centres for v in c), default=0), 1 << 1000)

    def below(limit: int) -> np.ndarray:
        # most + top <= sqrt(limit / dims), with a margin for the root and the sum.
        return most + float(top) <= (limit / dims) ** 0.5 * (1 - 1e-12) - 1

    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    exact = below(1 << 53)
    if exact.any():
        c, part = np.array(centres, np.float64), x[exact]
        d = (part * part).sum(axis=1)[:, None] - 2.0 * (part @ c.T) + (c * c).sum(axis=1)[None, :]
        cluster[exact] = d.argmin(axis=1)  # the first of equals
        distance[exact] = d.min(axis=1).astype(np.int64)
    wide = below(1 << 63) & ~exact
    if wide.any():
        c, part = np.array(centres, np.int64), x[wide].astype(np.int64)
        d = np.stack([((part - own) ** 2).sum(axis=1) for own in c], axis=1)
        cluster[wide] = d.argmin(axis=1)
        distance[wide] = d.min(axis=1)
    for i in np.flatnonzero(~exact & ~wide):
        own = _python(raw[i])
        all_ = [sum((a - b) ** 2 for a, b in zip(own, c)) for c in centres]
        distance[i] = min(all_)
        cluster[i] = all_.index(distance[i])
    return cluster, [int(v) for v in distance]


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK):
        x = batch.column(1).slice(at, BLOCK)
        whole, most = _integers(x, dims)
        yield at, whole, most, x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _added(a: list | None, b: list | None) -> list | None:
    """Sums of two parts, cluster by cluster: [count, distance, component sums]."""
    if a is None or b is None:
        return b if a is None else a
    return [[m + n, d + e, [v + w for v, w in zip(s, t)]] for (m, d, s), (n, e, t) in zip(a, b)]


def _summed(rows: DataFrame, centres: list[list[int]]) -> list:
    """[count, distance, component sums] of each cluster over all rows, in exact integers."""
    dims = len(centres[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0, 0, [0] * dims] for _ in centres]
        for batch in batches:
            for _, x, most, raw in _blocks(batch, dims):
                cluster, distance = nearest(x, most, raw, centres)
                # Sums of a block stay exact in 64 bits below 2^63 / BLOCK; rows beyond are added one by one.
                small = most < float(2**50)
                for k in range(len(centres)):
                    own = (cluster == k) & small
                    sums = x[own].astype(np.int64).sum(axis=0).tolist() if own.any() else [0] * dims
                    here = np.flatnonzero(cluster == k)
                    part = [len(here), sum(distance[i] for i in here), sums]
                    for i in here[~small[here]]:
                        part[2] = [v + w for v, w in zip(part[2], _python(raw[i]))]
                    total[k] = _added([total[k]], [part])[0]
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(total)])], names=["sums"])

    zero = [[0, 0, [0] * dims] for _ in centres]
    return rows.mapInArrow(run, "sums string").rdd.map(lambda r: json.loads(r[0])).treeAggregate(zero, _added, _added)


def first_centres(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors whose lowercase-hex SHA-256 of ``seed:vec_id`` is smallest, in that order; rows without an id come last, rows of one id by their components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ID).cast("string")).cast("binary"), 256)
    best = rows.select(name.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k)
    return [_python(r["x"]) for r in best.collect()]


def fit(rows: DataFrame, k: int, rounds: int, seed: int) -> list[list[int]]:
    """The centroids after ``rounds`` rounds: each becomes its vectors' exact componentwise floor(sum / count), an empty one stays."""
    centres = first_centres(rows, k, seed)
    for _ in range(rounds if centres else 0):
        centres = [[v // n for v in s] if n else c for (n, _, s), c in zip(_summed(rows, centres), centres)]
    return centres


def _digest(centre: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, id_col: str = ID, vector_col: str = VECTOR
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept row of ``vectors``.

    Rows with another number of components, or a null or non-finite one, are left
    out; so is a null vector. Repeated rows count each; ids may be null or repeat.
    Of equally near centroids the smaller number wins. With fewer than ``k`` rows
    there are fewer centroids; an empty table gives no rows. Distances and their
    sums are exact; one that a long cannot hold reads as the greatest long. Other
    columns of ``vectors``, whatever their names, are not looked at. ``vectors`` is
    read once for each round and twice more, so it should be a table, not a long plan.
    """
    rows = kept(vectors, dims, id_col, vector_col)
    centres = fit(rows, k, rounds, seed)
    kind = rows.schema[ID].dataType.simpleString()
    own = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    if not centres:
        none: Column = F.lit(None)
        return rows.where("false").select(ID, *[none.cast(t).alias(n) for n, t in own.items()])
    inertias = [d for _, d, _ in _summed(rows, centres)]
    digests, total = [_digest(c) for c in centres], min(sum(inertias), LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x, most, raw in _blocks(batch, dims):
                number, distance = nearest(x, most, raw, centres)
                number = number.tolist()
                columns = [
                    batch.column(0).slice(at, len(number)),
                    pa.array(number, pa.int32()),
                    pa.array([min(d, LONG) for d in distance], pa.int64()),
                    pa.array([min(inertias[n], LONG) for n in number], pa.int64()),
                    pa.array([total] * len(number), pa.int64()),
                    pa.array([digests[n] for n in number], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[ID, *own])

    return rows.mapInArrow(run, ", ".join([f"{ID} {kind}", *[f"{n} {t}" for n, t in own.items()]]))
