"""Small document tables with the awkward cases: nulls, empty and long texts, ties, repeats, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, k string"


def words(rnd, n):
    return " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def documents(spark, seed=1, n=60):
    """The columns fp, score and k are named like some that operators use inside."""
    rnd = random.Random(seed)
    base = [words(rnd, rnd.choice([3, 40, 90, 160])) for _ in range(n)]
    shared = words(rnd, 120)
    out = []
    for i in range(n):
        text = base[i]
        if i % 6 == 1:
            text = base[i - 1]
        if i % 6 == 2:
            w = base[i - 2].split(" ")
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        if i % 6 == 3:
            text = base[i] + "\n" + shared + "\n" + words(rnd, 20)
        out.append((i, text))
    out += [(n, None), (n + 1, ""), (n + 2, "   \n\t "), (n + 3, "one two"), (n + 4, "Ünïcode ß 漢字 🙂 " * 60), (n + 5, words(rnd, 9000)), (None, "no id here"), (n + 6, "a" * 3000)]
    out += [out[5], out[5]]
    return spark.createDataFrame([(i, t, "en", None, None, 1, 0.5, "x") for i, t in out], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]
