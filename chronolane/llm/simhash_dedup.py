"""SimHash near-duplicates by tiled exact comparison of fingerprints.

1. ``fingerprints``: 64-bit SimHash of word shingles, one Arrow pass over the texts.
2. Equal fingerprints meet in a map-side aggregation, so copies cost nothing later.
3. Distinct fingerprints fall into cells by the bit counts of ``LANES`` lanes of
   the 64 bits. Two fingerprints within ``radius`` bits lie in cells whose counts
   differ by ``radius`` at most in sum, so all other pairs of cells are skipped.
   Cells are cut into tiles of about ``TILE`` fingerprints (a hot cell becomes
   many tiles), and tiles of neighbouring cells meet by an equi-join on the tile.
4. A task compares two tiles with exclusive-or and bit counts in numpy and
   returns a spanning forest of what it found, never all pairs of a group.
5. Forests are joined by ``components``.

The only broadcast is the table of cells: 23 * 22 * 22 rows at most.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOC_ID, TEXT, lean, texts, utf8, written
from .components import components

#: Bits of the three lanes; their bit counts name a cell.
LANES = (22, 21, 21)
TILE = 512
SEED = 42


def shingle_spans(words: list[bytes], width: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and where each shingle of ``width`` words starts and ends in that."""
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) < width:
        return joined, [0], [len(joined)]
    return joined, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()


def simhash(text: str, width: int) -> int:
    words = utf8(text).lower().split()  # bytes: only A-Z change, and only ASCII white space parts
    if not words:
        return 0
    joined, starts, ends = shingle_spans(words, width)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long.

    A null or empty text, or one of white space only, has fingerprint zero;
    fewer words than ``width`` are one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, int] = {}
            fps = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text not in known:
                    known[text] = simhash(text, width)
                fps[i] = known[text]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[DOC_ID, "fp"])

    return texts(docs).select(F.col(DOC_ID).cast("long"), TEXT).mapInArrow(run, f"{DOC_ID} long, fp long")


def _lanes(fp: Column) -> list[Column]:
    out, shift = [], 0
    for width in LANES:
        out.append(F.bit_count(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))))
        shift += width
    return out


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Steps between cells that can hold a pair within the radius, one of each two opposite steps, and none."""
    steps = itertools.product(range(-radius, radius + 1), repeat=len(LANES))
    return [s for s in steps if sum(map(abs, s)) <= radius and s >= (0,) * len(LANES)]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges: as much connection with fewer edges than nodes."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[own], nodes[label[own]]


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    found_u, found_v, held = [], [], 0
    rows = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        found_u.append(a[at + i])
        found_v.append(b[j])
        held += len(i)
        if held > 4 * (len(a) + len(b)):
            u, v = forest(np.concatenate(found_u), np.concatenate(found_v))
            found_u, found_v, held = [u], [v], len(u)
    u, v = np.concatenate(found_u), np.concatenate(found_v)
    apart = u != v
    u, v = u[apart], v[apart]
    return forest(u, v) if len(u) else (u, v)


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(u, v): links between different fingerprints of column fp that connect all within ``radius``."""
    celled = distinct.select("fp", F.concat_ws("_", *_lanes(F.col("fp"))).alias("cell"), *[c.alias(f"p{i}") for i, c in enumerate(_lanes(F.col("fp")))])
    # One row a cell, 23 * 22 * 22 at most whatever the input, so the broadcast is bounded.
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    salted = celled.join(F.broadcast(cells), "cell").withColumn(
        "salt", F.pmod(F.xxhash64(F.lit("tile"), "fp"), F.ceil(F.col("n") / TILE)).cast("int")
    )
    tiles = salted.groupBy("cell", "salt", *[f"p{i}" for i in range(len(LANES))]).agg(F.collect_list("fp").alias("fps"))
    steps = F.array(*[F.array(*[F.lit(x) for x in s]) for s in _offsets(radius)])
    sent = (
        tiles.withColumn("step", F.explode(steps))
        .select(
            F.concat_ws("_", *[F.col(f"p{i}") + F.col("step")[i] for i in range(len(LANES))]).alias("to"),
            F.col("cell").alias("of"),
            F.col("salt").alias("of_salt"),
            F.col("fps").alias("a"),
        )
        .join(F.broadcast(cells.select(F.col("cell").alias("to"), "n")), "to")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / TILE).cast("int") - 1)))
        .where("of <> to or of_salt <= salt")
    )
    # The key is a tile, not a cell, so that a hot cell's pairs of tiles go to many tasks.
    pairs = sent.join(tiles.select(F.col("cell").alias("to"), "salt", F.col("fps").alias("b")), ["to", "salt"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            us, vs = [], []
            for a, b in zip(pdf["a"], pdf["b"]):
                u, v = compare_tiles(np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64), radius)
                us.append(u)
                vs.append(v)
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return pairs.select("a", "b").mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Documents link if their fingerprints differ in ``radius`` bits or fewer;
    component_id is the smallest doc_id that links reach. Repeated rows stay
    repeated, other columns of ``docs`` are not looked at, a null doc_id links
    like any other but is never a smallest id. An empty table gives no rows.
    """
    marked = written(fingerprints(docs, width))
    distinct = written(marked.groupBy("fp").agg(F.min(DOC_ID).alias("first_id")))
    roots = components(near_links(distinct, radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select(
        DOC_ID, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: For ``similar_documents``: 64-bit words of a fingerprint, greatest distance of candidates, fingerprints in a tile, and texts and shingles in a tile of shingle sets.
WORDS, WIDE_RADIUS, WIDE_TILE, SET_TILE, SET_SHINGLES = 4, 80, 8192, 1024, 1 << 20
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))

_TIES = np.arange(64) % 2


def shingle_hashes(text: str, width: int, seed: int) -> np.ndarray:
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, starts, ends = shingle_spans(words, width)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends)), np.uint64, len(starts)))


def wide_simhash(bag: np.ndarray) -> list[int]:
    """``WORDS`` times 64 bits: each 1 if set in over half of the shingles' hashes; a tie is 1 at every other place, whatever the set."""
    out = []
    for k in range(WORDS):
        h = bag * _FACTORS[k]
        h ^= h >> np.uint64(32)
        h *= _FACTORS[(k + 1) % len(_FACTORS)]
        h ^= h >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 15):
            part = h[at : at + (1 << 15)].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = (2 * ones + _TIES > len(h)).astype(np.uint8)
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return out


def _name(bag: np.ndarray) -> list[int]:
    """128 bits that name a set of shingles, as two signed longs."""
    return np.frombuffer(xxhash.xxh3_128_digest(bag.astype("<u8").tobytes()), "<i8").tolist()


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, size, name, name2, fps): number of distinct shingles, the name of their set, and its wide fingerprint."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, tuple] = {}
            for text in set(batch.column(1).to_pylist()):
                bag = shingle_hashes(text, width, SEED)
                known[text] = (len(bag), *_name(bag), wide_simhash(bag))
            rows = [known[text] for text in batch.column(1).to_pylist()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (*[pa.int64()] * 3, pa.list_(pa.int64())))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=[DOC_ID, "text_name", "size", "name", "name2", "fps"])

    ids = texts(docs).select(F.col(DOC_ID).cast("long"), TEXT, text_name().alias("text_name")).where(F.col(DOC_ID).isNotNull())
    return ids.mapInArrow(run, f"{DOC_ID} long, text_name string, size long, name long, name2 long, fps array<long>")


def text_name() -> Column:
    """128 bits that tell a text, null read as empty, from others."""
    return F.md5(F.coalesce(F.col(TEXT).cast("string"), F.lit("")).cast("binary"))


def near_pairs(a: np.ndarray, b: np.ndarray, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the nodes of two tiles (rows: node, size, words of the fingerprint) that lie within the radius and can be alike by size."""
    us, vs, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    rows = max(1, (1 << 18) // max(1, len(b)))
    words = b[:, 2:].view(np.uint64).T.copy()
    for at in range(0, len(a), rows):
        x = a[at : at + rows]
        apart = np.zeros((len(x), len(b)), np.uint16)
        for k in range(WORDS):
            apart += np.bitwise_count(x[:, 2 + k].view(np.uint64)[:, None] ^ words[k][None, :])
        i, j = np.nonzero(apart <= radius)
        fits = np.minimum(x[i, 1], b[j, 1]) >= similarity * np.maximum(x[i, 1], b[j, 1])
        fits &= x[i, 0] != b[j, 0]
        us.append(x[i[fits], 0])
        vs.append(b[j[fits], 0])
        held += int(fits.sum())
        if held > 4 * (len(a) + len(b)):
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], len(u)
    u, v = np.concatenate(us), np.concatenate(vs)
    return forest(u, v) if len(u) else (u, v)


def _candidates(distinct: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(u, v): links that connect all nodes within the radius of which sets can be alike; distinct: node, size, fps.

    Sizes fall into bands, each as wide as sizes of alike sets can differ, so only
    tiles of one band and of the next are compared.
    """
    # Two different sets of fewer elements than that are never alike.
    banded = distinct.where(F.col("size") >= similarity / (1 - similarity) - 1e-6).withColumn("band", F.floor(F.log("size") / -math.log(similarity) + 1e-9).cast("int"))
    bands = {r["band"]: -(-r["n"] // WIDE_TILE) for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # some log(size) rows
    counts = F.create_map(*[F.lit(x) for kv in bands.items() for x in kv]) if bands else F.create_map(F.lit(0), F.lit(1))
    tiles = (
        banded.withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), "node"), counts[F.col("band")]).cast("int"))
        .groupBy("band", "tile")
        .agg(F.flatten(F.collect_list(F.concat(F.array("node", "size"), "fps"))).alias("rows"))
    )
    upto = lambda band: F.sequence(F.lit(0), F.coalesce(counts[band], F.lit(1)).cast("int") - 1)
    left = tiles.withColumn("band2", F.explode(F.array("band", F.col("band") + 1))).withColumn("tile2", F.explode(upto(F.col("band2"))))
    right = tiles.select(F.col("band").alias("band2"), F.col("tile").alias("tile2"), F.col("rows").alias("rows2"), F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    right = right.withColumn("tile", F.explode(upto(F.col("band"))))
    pairs = left.join(right, ["band", "tile", "band2", "tile2"]).where("band <> band2 or tile <= tile2")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = (z.values.to_numpy().reshape(-1, 2 + WORDS) for z in (x, y))
                u, v = near_pairs(a, b, similarity, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return pairs.select("rows", "rows2").mapInArrow(run, "u long, v long")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``: frequent ones by products of 0-1 matrices, rare ones one by one."""
    out = np.zeros((len(a), len(b)), np.float32)
    of_a, of_b = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b))
    names, flat = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    flat_a, flat_b = flat[: len(of_a)], flat[len(of_a) :]
    n_a, n_b = np.bincount(flat_a, minlength=len(names)), np.bincount(flat_b, minlength=len(names))
    rare = (n_a > 0) & (n_b > 0) & (n_a * n_b < 64)
    if rare.any():
        order_b = np.argsort(flat_b, kind="stable")
        first_b = np.searchsorted(flat_b[order_b], np.arange(len(names)))
        mine = np.nonzero(rare[flat_a])[0]
        wide = n_b[flat_a[mine]]
        step = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        theirs = of_b[order_b[np.repeat(first_b[flat_a[mine]], wide) + step]]
        out += np.bincount(np.repeat(of_a[mine], wide) * len(b) + theirs, minlength=out.size).reshape(out.shape)
    common = np.nonzero((n_a > 0) & (n_b > 0) & ~rare)[0]
    for at in range(0, len(common), 2048):
        column = np.full(len(names), -1)
        column[common[at : at + 2048]] = np.arange(len(common[at : at + 2048]))
        ones = []
        for own, ids, n in ((flat_a, of_a, len(a)), (flat_b, of_b, len(b))):
            x = np.zeros((n, len(common[at : at + 2048])), np.float32)
            here = column[own] >= 0
            x[ids[here], column[own[here]]] = 1
            ones.append(x)
        out += ones[0] @ ones[1].T
    return out


def _alike(bags: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links that connect all nodes of one candidate group (root) whose sets (bag) are alike; a large group becomes many tiles."""
    groups = bags.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("bag")).alias("shingles"))
    groups = groups.select("root", F.greatest(F.ceil(F.col("n") / SET_TILE), F.ceil(F.col("shingles") / SET_SHINGLES)).cast("int").alias("tiles"))
    dealt = bags.join(groups, "root").withColumn("tile", F.pmod(F.xxhash64(F.lit("set"), "node"), F.col("tiles")).cast("int"))
    tiles = dealt.groupBy("root", "tile", "tiles").agg(F.collect_list(F.struct("node", "bag")).alias("sets"))
    # Every pair of tiles of a group once; a group of one tile meets itself.
    sent = tiles.select("root", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"), "tile", "sets")
    sent = sent.select("root", F.least("tile", "other").alias("tile"), F.greatest("tile", "other").alias("tile2"), (F.col("tile") <= F.col("other")).alias("first"), "sets")
    pairs = sent.groupBy("root", "tile", "tile2").agg(F.first(F.when(F.col("first"), F.col("sets")), True).alias("a"), F.first(F.when(~F.col("first"), F.col("sets")), True).alias("b"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(x) -> tuple[np.ndarray, list[np.ndarray]]:
            values = x.values
            lists = values.field("bag")
            return values.field("node").to_numpy(), [y.values.to_numpy() for y in lists]

        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                ids, own = sets(x)
                ids2, other = sets(y) if y.is_valid else (ids, own)
                both = shared_counts(own, other)
                size, size2 = (np.array([len(z) for z in q]) for q in (own, other))
                i, j = np.nonzero(both * (1 + similarity) + 1e-3 >= similarity * (size[:, None] + size2[None, :]))
                u, v = ids[i], ids2[j]
                u, v = u[ids[i] != ids2[j]], v[ids[i] != ids2[j]]
                u, v = forest(u, v) if len(u) else (u, v)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return pairs.select("a", "b").mapInArrow(run, "u long, v long")


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS) -> DataFrame:
    """(doc_id, text_name, component_id, first) for every row of ``docs`` with an id: groups of texts whose word shingles are alike.

    Texts link if the Jaccard similarity of their sets of ``width``-word shingles
    is ``similarity`` or more. Equal sets are one text. Fingerprints of 256 bits are
    compared tile by tile; those within ``radius`` bits form candidate groups, and
    in a group every two sets are compared exactly, again tile by tile. At a
    similarity of 0.8 fingerprints differ in 25 to 41 bits on average (48 for sets of
    five and four shingles) with a deviation of 5 to 6, so the radius loses none in a million.
    Each tile pair returns a forest, never all pairs. Texts without words are
    alike. component_id is the smallest doc_id of the group, ``first`` whether a row has
    that id and, of texts that share it, the set with the least name. Rows with a null
    doc_id are left out; different texts that share an id are different texts.
    """
    marked = written(_marked(docs, width))
    sets_ = marked.groupBy("name", "name2").agg(F.min(DOC_ID).alias("first_id"), F.first("size").alias("size"), F.first("fps").alias("fps"))
    distinct = written(sets_.withColumn("node", F.monotonically_increasing_id()))
    groups = components(_candidates(distinct, similarity, radius))
    rooted = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())
    wanted = written(distinct.select("node", "first_id", "name", "name2").join(rooted, "node"))

    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, node, root, *name in zip(*(c.to_pylist() for c in batch.columns)):
                bag = shingle_hashes(text, width, SEED)
                if _name(bag) == name:  # else it is another text with this id
                    rows.append((root, node, bag.view(np.int64)))
            if rows:
                root, node, bag = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array(node, pa.int64()), pa.array(bag, pa.list_(pa.int64()))], names=["root", "node", "bag"])

    found = texts(docs).select(F.col(DOC_ID).cast("long").alias("first_id"), TEXT).join(wanted, "first_id").select(TEXT, "node", "root", "name", "name2")
    bags = written(found.mapInArrow(sets, "root long, node long, bag array<long>").dropDuplicates(["node", "root"]))
    roots = components(_alike(bags, similarity))
    labelled = written(distinct.join(roots, "node", "left").select("name", "name2", "first_id", F.coalesce("root", "node").alias("root")))
    least = labelled.groupBy("root").agg(F.min(F.struct("first_id", "name", "name2")).alias("least"))
    told = marked.join(labelled.join(least, "root").select("name", "name2", "least"), ["name", "name2"])
    first = F.struct(DOC_ID, "name", "name2") == F.col("least")
    return told.select(DOC_ID, "text_name", F.col("least.first_id").alias("component_id"), first.alias("first"))


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS) -> DataFrame:
    """(doc_id, component_id) of ``similar_texts``."""
    return similar_texts(docs, width, similarity, radius).select(DOC_ID, "component_id")
