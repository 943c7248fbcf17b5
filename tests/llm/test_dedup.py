import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from chronolane.llm import components, simhash_dedup, suffix_dedup

from .helpers import SCHEMA, documents, rows, words


def _fingerprint(text, width=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _groups(n, links):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_equals_brute_force(spark):
    docs = documents(spark)
    data = rows(docs)
    fps = [_fingerprint(r["text"]) for r in data]
    group = _groups(len(data), [(i, j) for i in range(len(data)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for i, g in enumerate(group):
        if data[i]["doc_id"] is not None:
            least[g] = min(least.get(g, 1 << 60), data[i]["doc_id"])
    want = sorted((str(r["doc_id"]), format(f, "016x"), least.get(g)) for r, f, g in zip(data, fps, group))
    got = simhash_dedup.near_duplicates(docs)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in rows(got)) == want


def test_tiles_find_all_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for n in (1, 2, 3, 4, 5):
            x = int(b)
            for bit in rng.choice(63, n, replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    links = simhash_dedup.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)
    found = {r["node"]: r["root"] for r in rows(components.components(links))}
    want = _groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [found.get(f, f) for f in fps] == [fps[g] for g in want]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert simhash_dedup.similar_documents(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.cut_texts(none).columns == none.columns


def test_similar_documents(spark):
    docs = documents(spark)

    def bag(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    data = [r for r in rows(docs) if r["doc_id"] is not None]
    bags = [bag(r["text"]) for r in data]

    def alike(a, b):
        return a == b or (len(a & b) >= 0.8 * len(a | b) and bool(a))

    group = _groups(len(data), [(i, j) for i in range(len(data)) for j in range(i) if alike(bags[i], bags[j])])
    want = sorted((r["doc_id"], min(data[j]["doc_id"] for j in range(len(data)) if group[j] == g)) for r, g in zip(data, group))
    assert sorted((r["doc_id"], r["component_id"]) for r in rows(simhash_dedup.similar_documents(docs))) == want


def test_similar_documents_joins_tight_clusters(spark):
    """Each text's nearest is in its own cluster; only links of 0.85 join the two."""
    a1 = [f"w{i}" for i in range(200)]
    a2 = [*a1[:-1], "other"]
    b1 = [f"x{i}" if i in (40, 90, 140) else w for i, w in enumerate(a1)]
    b2 = [*b1[:-1], "another"]
    far = [f"y{i}" if i in (20, 60, 75, 100, 125, 160) else w for i, w in enumerate(b1)]
    docs = spark.createDataFrame(list(enumerate(" ".join(t) for t in (a1, a2, b1, b2, far))), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in rows(simhash_dedup.similar_documents(docs))}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}


def test_similar_documents_finds_short_texts_at_the_limit(spark):
    """Nine words and the same without the last: four shingles of five."""
    texts = [" ".join(f"{c}{i}" for c in "abcdefghi") for i in range(300)]
    texts += [t.rsplit(" ", 1)[0] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in rows(simhash_dedup.similar_documents(docs))}
    assert got == {i: i % 300 for i in range(600)}


def _removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return data, out


def test_repeats_equal_brute_force(spark):
    docs = documents(spark)
    data = rows(docs)
    texts, gone = _removed([r["text"] for r in data], 400)
    want = Counter((str(r["doc_id"]), hashlib.sha256(bytes(b for b, g in zip(t, x) if not g)).hexdigest(), sum(x)) for r, t, x in zip(data, texts, gone))
    got = Counter(
        (str(r["doc_id"]), hashlib.sha256(r["kept"]).hexdigest(), sum(s["e"] - s["s"] for s in r["spans"])) for r in rows(suffix_dedup.remove_repeats(docs))
    )
    assert got == want and any(k[2] for k in want)


def test_repeats_of_all_lengths_around_the_limit(spark):
    rnd = random.Random(2)

    def letters(n):
        return "".join(rnd.choice("abcdefgh") for _ in range(n))

    texts = []
    for n in (398, 399, 400, 401, 455, 520, 559, 700):
        piece = letters(n)
        texts += [letters(rnd.randint(0, 300)) + piece + letters(rnd.randint(0, 300)), letters(rnd.randint(0, 900)) + piece]
    texts.append(letters(90) * 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: sum(x) for i, x in enumerate(_removed(texts, 400)[1])}
    got = {r["doc_id"]: sum(s["e"] - s["s"] for s in r["spans"]) for r in rows(suffix_dedup.remove_repeats(docs))}
    assert got == want


def _mixture(rnd, length, alphabet):
    """Texts with pieces around the length, near copies, periods, empty and equal texts."""

    def letters(n):
        return "".join(rnd.choice(alphabet) for _ in range(max(1, int(n))))

    pieces = [letters(length * f) for f in (0.9, 1, 1.01, 1.2, 2.5)]
    base = letters(length * 5)
    texts = []
    for _ in range(20):
        texts.append(letters(rnd.randint(1, 2 * length)) + "".join(rnd.choice(pieces) + letters(rnd.randint(1, length)) for _ in range(rnd.randint(0, 3))))
    for _ in range(4):
        near = list(base)
        near[rnd.randrange(len(near))] = "Z"
        texts.append("".join(near))
    return [*texts, "a" * (3 * length), letters(length // 4) * 12, "", None, texts[0], texts[1]]


@pytest.mark.parametrize("length", [1, 20, 100, 174])
def test_repeats_of_any_length_equal_brute_force(spark, length):
    texts = _mixture(random.Random(length), length, "abcdefgh" if length > 1 else [chr(200 + i) for i in range(900)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    data, gone = _removed(texts, length)
    want = {i: bytes(b for b, g in zip(d, x) if not g) for i, (d, x) in enumerate(zip(data, gone))}
    assert {r["doc_id"]: bytes(r["kept"]) for r in rows(suffix_dedup.remove_repeats(docs, length))} == want


def test_suffix_ranks_equal_sorted_suffixes(spark):
    rnd = random.Random(5)
    seqs = [[rnd.randint(1, 2) for _ in range(n)] for n in (1, 2, 3, 4, 17, 40)] + [[1] * 12, [1, 2] * 9]
    for every in (1, 3):
        asked = {(s, i): rnd.randrange(every) == 0 for s, seq in enumerate(seqs) for i in range(len(seq))}
        names = [(s, i, seqs[s][i], i, i + 1, yes) for (s, i), yes in asked.items()]
        df = spark.createDataFrame(names, "seq long, i int, name long, at long, reach long, asked boolean")
        got = {(r["seq"], r["i"]): r["rank"] for r in rows(suffix_dedup.suffix_ranks(df, 1000))}
        suffixes = {(s, i): seqs[s][i:] for (s, i), yes in asked.items() if yes}
        assert got == {k: 1 + sum(o < v for o in suffixes.values()) for k, v in suffixes.items()}


def test_cut_texts_spares_short_repeats(spark):
    rnd = random.Random(6)
    few, many = words(rnd, 40), words(rnd, 60)
    texts = [words(rnd, 30) + " " + p + " " + words(rnd, 30) for p in (few, few, many, many)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in rows(suffix_dedup.cut_texts(docs, 100, 50))}
    assert got[0] == texts[0] and got[1] == texts[1]
    assert all(many not in got[i] and got[i].startswith(texts[i][:50]) for i in (2, 3))


def test_ids_stay_whole_beside_nulls(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "one two three four five"), (None, "six seven"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in rows(simhash_dedup.near_duplicates(docs))} == {big, None, big + 2}
    assert {r["doc_id"] for r in rows(simhash_dedup.similar_documents(docs))} == {big, big + 2}


def test_wide_fingerprints_of_alike_sets_lie_within_the_radius():
    rng = np.random.default_rng(1)
    for size, shared in ((5, 4), (10, 8), (60, 48), (600, 480)):
        worst = 0
        for _ in range(300):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            b = a[:shared] if size < 20 else np.concatenate([a[: round(size * 8 / 9)], rng.integers(0, 1 << 63, size - round(size * 8 / 9), dtype=np.uint64)])
            x, y = (np.array(simhash_dedup.wide_simhash(np.unique(z)), np.int64).view(np.uint64) for z in (a, b))
            worst = max(worst, int(np.bitwise_count(x ^ y).sum()))
        assert worst <= simhash_dedup.WIDE_RADIUS, (size, worst)


def test_shared_counts_equal_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 60)).astype(np.int64)) for _ in range(25)]
    got = simhash_dedup.shared_counts(sets, sets[:7])
    assert got.tolist() == [[float(len(set(a.tolist()) & set(b.tolist()))) for b in sets[:7]] for a in sets]


def test_cut_texts_keeps_columns_and_characters(spark):
    docs = documents(spark)
    out = suffix_dedup.cut_texts(docs)
    assert out.columns == docs.columns
    for r in rows(out):
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
