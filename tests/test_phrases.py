"""All phrases in one pass: the best one as a loop over all of them finds it."""

import random

from pyspark.sql import functions as F

from chronolane.functions import fuzzy
from chronolane.operators import privacy


def brute(phrases, text, least):
    scores = [(-fuzzy.partial_ratio_of(p, text), i) for i, p in enumerate(phrases)]
    best = min(scores)
    return (best[1], -best[0]) if -best[0] >= least else None


def test_common_lengths_of_many_phrases():
    rnd = random.Random(1)
    for _ in range(100):
        phrases = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 90))) for _ in range(7)]
        text = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 60)))
        assert fuzzy.Phrases(phrases).common(text) == [fuzzy.common_subsequence(p, text) for p in phrases]


def test_best_phrase_equals_a_loop(spark, monkeypatch):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("etaoins") for _ in range(rnd.randint(2, 6)))
    phrases = [" ".join(word() for _ in range(rnd.randint(2, 5))) for _ in range(60)]
    phrases.append(phrases[3])  # the first of equals counts
    texts = ["", "e", None] + [" ".join(word() for _ in range(rnd.randint(1, 25))) for _ in range(40)]
    for i in range(30):
        own = list(f"{word()} {rnd.choice(phrases)} {word()}")
        for _ in range(rnd.randint(0, 5)):
            own[rnd.randrange(len(own))] = rnd.choice("xyz ")
        texts.append("".join(own))
    for least in (50, 80, 100):
        want = [None if t is None else brute(phrases, t, least) for t in texts]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = {r["i"]: r["hit"] and (r["hit"]["place"], r["hit"]["score"]) for r in df.select("i", fuzzy.best_phrase(F.col("t"), phrases, least).alias("hit")).collect()}
        assert [got[i] for i in range(len(texts))] == want
    calls = []
    monkeypatch.setattr(fuzzy, "partial_ratio_of", lambda a, b, f=fuzzy.partial_ratio_of: calls.append(1) or f(a, b))
    many = fuzzy.Phrases(phrases)
    for t in texts[3:]:
        many.best(t, 90)
    assert len(calls) < 0.5 * len(phrases) * len(texts)


def test_best_template_without_templates(spark):
    none = spark.createDataFrame([], "template_id string, ord int, tail string")
    row = privacy.best_template(spark.createDataFrame([("x",)], "t string"), "t", none).first()
    assert row["hit"] is None


def test_match_equals_all_pairs(spark, monkeypatch):
    from chronolane.operators import catalog

    monkeypatch.setattr(catalog, "ASKED", 7)
    monkeypatch.setattr(catalog, "LISTED", 11)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("etaoins ") for _ in range(rnd.randint(1, 30)))
    names = [(rnd.randrange(40), word()) for _ in range(60)] + [(90, ""), (91, "long " * 40)]
    asked = [(i, n[1][:2] + rnd.choice(["", "x", " ab"]) + n[1][2:]) for i, n in enumerate(names)] + [(100, ""), (101, "q" * 300), (102, names[3][1])]
    want = {}
    for i, t in asked:
        best = {}
        for entry, alias in names:
            ratio = fuzzy.ratio_of(t, alias)
            if ratio >= 70:
                best[entry] = max(best.get(entry, 0), ratio)
        order = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))
        if order:
            want[i] = (order[0][0], order[0][1], order[0][1] - order[1][1] if len(order) > 1 else None)
    df = catalog.match(spark.createDataFrame(asked, "asked int, text string"), spark.createDataFrame(names, "entry_id int, alias string"))
    assert {r["asked"]: (r["entry_id"], r["score"], r["margin"]) for r in df.collect()} == want
    assert "CartesianProduct" not in df._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in df._jdf.queryExecution().toString()
    none = spark.createDataFrame([], "entry_id int, alias string")
    assert catalog.match(spark.createDataFrame(asked, "asked int, text string"), none).count() == 0
