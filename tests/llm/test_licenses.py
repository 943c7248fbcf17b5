import random
from collections import Counter

from chronolane.llm import licenses

from .helpers import rows, words


def test_wrapped_notices_and_lines_without_cue_words(spark):
    files = [
        ("a", "lib/LICENSE", "This Source Code Form is subject to the terms\nof the Mozilla Public License, version 2.0."),
        ("b", "lib/x.py", "import os"),
        ("c", "pub/y.py", "print(1)\nThis is free and unencumbered software into the public domain.\nprint(2)"),
        ("d", "web/z.py", "This Source Code Form is subject to the terms\nof the Mozilla Public License, version 2.0.\n\n" + "some other words entirely\n" * 30),
        ("e", "pub/w.py", "nothing of the kind"),
    ]
    df = spark.createDataFrame(files, "file_id string, path string, text string")
    got = {r["file_id"]: (r["license"], r["how"], r["cosine"]) for r in rows(licenses.scan(df, licenses.templates(spark)))}
    assert got["a"] == ("MPL-2.0", "file", 1.0)
    assert got["b"] == ("MPL-2.0", "inherited", 1.0)
    assert got["c"][:2] == ("Unlicense", "header")
    assert got["d"] == ("MPL-2.0", "header", 1.0)
    assert got["e"][1] == "none"


def _cosine_by_hand(texts, forms):
    """The best template of each text by TF-IDF cosine over lines, as a plain loop."""
    import math
    import re

    def bag(t):
        return Counter(re.findall(licenses.WORD, t.lower()))

    lines = [line for t in texts for line in t.split("\n")]
    vocabulary = {w for f in forms.values() for w in bag(f)}
    df = Counter(w for line in lines for w in set(bag(line)) & vocabulary)
    idf = lambda w: math.log((len(lines) + 1) / (df[w] + 1)) + 1 if w in vocabulary else math.log(len(lines) + 1) + 1

    def cosine(a, b):
        x, y = ({w: n * idf(w) for w, n in bag(t).items()} for t in (a, b))
        dot = sum(v * y.get(w, 0) for w, v in x.items())
        size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return round(dot / size, 6) if size else 0.0

    return cosine


def test_every_text_against_every_template(spark):
    rnd = random.Random(3)
    forms = licenses.TEMPLATES
    some = [w for f in forms.values() for w in f.split()]
    texts = []
    for i in range(120):
        form = rnd.choice(list(forms.values())).split()
        for _ in range(rnd.randint(0, 6)):
            form.insert(rnd.randrange(len(form) + 1), rnd.choice(some + ["entirely", "other", "words"]))
        texts.append(" ".join(rnd.sample(form, rnd.randint(1, len(form))) if i % 3 else form))
    cosine = _cosine_by_hand(texts, forms)
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "file_id int, path string, text string")
    got = {r["file_id"]: (r["license"], r["cosine"]) for r in rows(licenses.scan(df, licenses.templates(spark)))}
    for i, t in enumerate(texts):
        best = min((-cosine(t, f), name) for name, f in forms.items())
        want = (best[1], -best[0]) if -best[0] >= licenses.FILE_COSINE else (None, None)
        assert got[i][0] == want[0] and (want[1] is None or abs(got[i][1] - want[1]) < 2e-6), (t, got[i], want)


def test_a_long_licence_text_is_found_by_its_own_template(spark):
    rnd = random.Random(4)
    whole = "\n\n".join(words(rnd, 60) + "\nlicense terms and conditions of this work\n" + words(rnd, 40) for _ in range(20))
    known = licenses.templates(spark, {**licenses.TEMPLATES, "Long-1.0": whole})
    files = [("a", "lib/LICENSE", whole), ("b", "lib/deep/er/x.py", "import os"), ("c", "x.py", None), ("a", "lib/LICENSE", whole), ("d", None, "")]
    got = rows(licenses.scan(spark.createDataFrame(files, "file_id string, path string, text string"), known))
    assert sorted((r["file_id"], r["license"] or "", r["how"]) for r in got) == [("a", "Long-1.0", "file")] * 2 + [("b", "Long-1.0", "inherited"), ("c", "", "none"), ("d", "", "none")]
    assert licenses.scan(spark.createDataFrame([], "file_id string, path string, text string"), known).count() == 0
