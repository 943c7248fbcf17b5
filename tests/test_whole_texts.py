"""Fuzzy queries against brute force on small tables: every text, every name."""

import random

from chronolane import plans
from chronolane.functions import fuzzy


def test_partial_ratio_equals_all_windows():
    rnd = random.Random(9)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, n))) for n in (9, 40))
        short, long = sorted((a, b), key=len)
        want = max(fuzzy.ratio_of(short, long[max(0, e - len(short)) : e]) for e in range(1, len(long) + len(short)))
        if len(a) == len(b):
            want = max(want, max(fuzzy.ratio_of(long, short[max(0, e - len(long)) : e]) for e in range(1, len(long) + len(short))))
        assert fuzzy.partial_ratio_of(a, b) == want


def test_templates_are_found_anywhere_in_a_turn(spark, tmp_path):
    tails = {"bench": ": the erhe thatnd", "ring": "and then for the onen"}
    turns = ["x" * 150 + " sent by Ann: the erhe thatnd", "first line\nsecond\ncall 5 and then for the onxn", "nothing", "", None]
    spark.createDataFrame([(1, i, "user", x) for i, x in enumerate(turns)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: (r.template_id, r.score) for r in plans.queries()["fuzzy_template_join"](spark, str(tmp_path)).collect()}

    def brute(tail, x):
        x = " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())
        return max((fuzzy.ratio_of(tail, x[max(0, e - len(tail)) : e]) for e in range(1, len(x) + len(tail))), default=0) if len(x) >= len(tail) else fuzzy.partial_ratio_of(tail, x)

    want = {}
    for i, x in enumerate(turns):
        score, name = max((brute(tail, x or ""), name) for name, tail in tails.items())
        if score >= 60:
            want[i] = (name, round(score, 4))
    assert got == want and set(got) == {0, 1}


def test_every_name_is_a_candidate(spark, tmp_path):
    long = "tin " + "nut" * 40
    names = ["cold bolt", "old bolt", "brass ring", long, long + "s"]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.asked: (r.entry_id, r.score, None if r.margin is None else round(r.margin, 4)) for r in plans.queries()["fuzzy_catalog_match"](spark, str(tmp_path)).collect()}
    want = {}
    for i, x in enumerate(names):
        scores = [(fuzzy.ratio_of(x[:3] + " x" + x[3:], y), -j) for j, y in enumerate(names)]
        best, *rest = sorted((s for s in scores if s[0] >= 70), reverse=True)
        want[i] = (-best[1], round(best[0]), round(best[0]) - round(rest[0][0]) if rest else None)
    assert got == want and got[0][2] is not None
