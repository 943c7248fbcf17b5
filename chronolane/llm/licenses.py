"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along directories, in DataFrame functions only.

Every line, every block of lines between blank ones and every whole text (as a
candidate licence file) is compared with every template, but for those that an
exact bound rules out: a template's lightest words, as long as their share of its
squared weights stays under the square of the least cosine, cannot reach that
cosine alone, so a match holds one of its other words (its cues). Only words of
the templates are looked up; how many lines hold each is counted over the whole
input, and words outside the templates weigh like a word that no line holds. A file without a
licence line takes the one of the nearest directory above it that has a licence
file, found by a join of its directories with those that have one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT, written

#: Fixed texts: the usual short notices of public licences.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
HEADER_COSINE, FILE_COSINE = 0.7, 0.7
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def templates(spark, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(sorted(texts.items()), "license string, template string")


def _cosines(units: DataFrame, forms: DataFrame, df: DataFrame, total: Column, least: float, key: list[str]) -> DataFrame:
    """(key, license, cosine) of the best template for each unit (key, words) that reaches ``least``; ties go to the first name."""
    outside = F.log(total + 1.0) + 1.0
    bag = units.withColumn("word", F.explode("words")).groupBy(*key, "word").agg(F.count(F.lit(1)).alias("tf"))
    weighed = bag.join(F.broadcast(df), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", outside))
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(forms), "word").groupBy(*key, "license", "form_norm").agg(F.sum(F.col("w") * F.col("form_w")).alias("dot"))
    scored = dots.join(norms, key).withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("form_norm")), 6)).where(F.col("cosine") >= least)
    best = scored.groupBy(*key).agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("best"))
    return best.select(*key, F.col("best.license").alias("license"), (-F.col("best.less")).alias("cosine"))


def cues(bags: list[tuple[str, str, int]], idf: dict[str, float], least: float) -> list[str]:
    """Words of which a text holds one at least if its cosine to any template (license, word, tf) reaches ``least``."""
    out: set[str] = set()
    weights: dict[str, list[tuple[float, str]]] = {}
    for license_, word, tf in bags:
        weights.setdefault(license_, []).append(((tf * idf[word]) ** 2, word))
    for words in weights.values():
        room = (least - 1e-6) ** 2 * sum(w for w, _ in words) - 1e-9
        for w, word in sorted(words):
            room -= w
            if room <= 0:
                out.add(word)
    return sorted(out)


def _can_reach(words: Column, idf: dict[str, float], outside: float, least: float) -> Column:
    """Whether some template's cosine can reach ``least``: no cosine exceeds the root of the template words' share of the squared weights."""
    if not idf:
        return F.lit(False)
    weights = F.create_map(*[F.lit(x) for pair in sorted(idf.items()) for x in pair])
    share = (least - 1e-6) ** 2  # cosines are rounded to six places

    def enough(words: Column, inside: Column) -> Column:
        times = lambda d: F.size(F.filter(inside, lambda x: x == d))
        own = F.aggregate(F.array_distinct(inside), F.lit(0.0), lambda sum_, d: sum_ + F.pow(times(d) * F.element_at(weights, d), F.lit(2.0)))
        # Words outside the templates weigh least if none repeats.
        return own >= share * (own + (F.size(words) - F.size(inside)) * outside**2)

    # Arrays of one element name a value, so that it is computed once.
    named = lambda ws: F.exists(F.array(F.filter(ws, lambda w: w.isin(*idf))), lambda ins: (F.size(ins) > 0) & enough(ws, ins))
    return F.exists(F.array(words), named)


def scan(files: DataFrame, known: DataFrame, header_cosine: float = HEADER_COSINE, file_cosine: float = FILE_COSINE) -> DataFrame:
    """(file_id, path, license, cosine, how, from_dir) for every row of ``files`` (file_id, path, text).

    how: ``header`` if a line or a block of lines matches a template (the best
    counts, then the first, lines before blocks), ``file`` if the whole text is one, ``inherited`` from
    the nearest directory at or above the file's own that holds a licence file (of
    several the best match, then the first name), ``none`` else (license and
    cosine null). A null text is empty, a null path lies in no directory; rows
    that repeat are judged alike. ``known``: (license, template), a short list.
    """
    spark = files.sparkSession
    base = files.select(
        "file_id", "path", F.coalesce(F.col(TEXT).cast("string"), F.lit("")).alias(TEXT)
    ).withColumn("key", F.xxhash64("file_id", "path", TEXT))
    bags = known.select("license", F.explode(_words(F.col("template"))).alias("word")).groupBy("license", "word").agg(F.count(F.lit(1)).alias("tf"))
    listed_bags = [(r["license"], r["word"], r["tf"]) for r in bags.collect()]  # of the templates, a list that the caller gives
    vocabulary = sorted({word for _, word, _ in listed_bags})
    each_line = base.select(F.explode(F.split(TEXT, "\n")).alias("content")).select(_words(F.col("content")).alias("words"))
    known_words = F.array_distinct(F.filter("words", lambda w: w.isin(*vocabulary)))
    counts = each_line.select(F.explode(F.concat(known_words, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["word"]: r["n"] for r in counts.collect()}  # one row for each word of the templates, and one for all lines
    n_lines = counts.pop("", 0)
    total = F.lit(float(n_lines))
    df = spark.createDataFrame([(w, counts.get(w, 0)) for w in vocabulary] or [], "word string, n long").select(
        "word", (F.log((total + 1.0) / (F.col("n") + 1.0)) + 1.0).alias("idf")
    )
    forms = bags.join(F.broadcast(df), "word").withColumn("form_w", F.col("tf") * F.col("idf"))
    forms = forms.withColumn("form_norm", F.sqrt(F.sum(F.col("form_w") * F.col("form_w")).over(Window.partitionBy("license")))).select("word", "license", "form_w", "form_norm")

    idf = {w: math.log((n_lines + 1.0) / (counts.get(w, 0) + 1.0)) + 1.0 for w in vocabulary}
    outside = math.log(n_lines + 1.0) + 1.0
    cued_words = cues(listed_bags, idf, min(header_cosine, file_cosine))
    # An array of one element, so that the text is put in lower case once.
    base_cued = base.where(F.exists(F.array(F.lower(TEXT)), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in cued_words], F.lit(False))))
    lines = base_cued.select("key", F.posexplode(F.split(TEXT, "\n")).alias("line", "content"))
    worded = lines.select("key", "line", _words(F.col("content")).alias("words"))
    blocks = base_cued.select("key", F.posexplode(F.split(TEXT, r"\n[ \t\r]*\n")).alias("block", "content")).where(F.trim(F.col("content"), F.lit("\n")).contains("\n"))
    blocks = blocks.select("key", (F.lit(1 << 30) + F.col("block")).alias("line"), _words(F.col("content")).alias("words"))
    # A line's cosine depends on its words alone: equal lines are compared once.
    likely = worded.unionAll(blocks).where(_can_reach(F.col("words"), idf, outside, min(header_cosine, file_cosine)))
    cued = written(likely.withColumn("content", F.xxhash64("words")))
    distinct = cued.groupBy("content").agg(F.first("words").alias("words"))
    matched = written(_cosines(distinct, forms, df, total, min(header_cosine, file_cosine), ["content"]))
    headers = (
        cued.join(matched.where(F.col("cosine") >= header_cosine), "content")
        .groupBy("key")
        .agg(F.min(F.struct((-F.col("cosine")).alias("less"), "line", "license")).alias("best"))
        .select("key", F.col("best.license").alias("header"), (-F.col("best.less")).alias("header_cosine"))
    )
    sizes = base_cued.select("key", "path", _words(F.col(TEXT)).alias("words")).where(_can_reach(F.col("words"), idf, outside, file_cosine))
    candidates = written(sizes.dropDuplicates(["key"]))
    whole_files = _cosines(candidates.select("key", "words"), forms, df, total, file_cosine, ["key"])
    licence_files = candidates.select("key", "path").join(whole_files, "key").withColumnsRenamed({"license": "file", "cosine": "file_cosine"})

    directory = F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1)
    dirs = (
        licence_files.where("path is not null")
        .withColumn("dir", F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1))
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("file_cosine")).alias("less"), F.col("file").alias("license"))).alias("best"))
        .select("dir", F.col("best.license").alias("dir_license"), (-F.col("best.less")).alias("dir_cosine"))
    )
    own_dirs = base.where("path is not null").select(directory.alias("own_dir")).distinct()
    steps = F.split("own_dir", "/")
    above = own_dirs.select(
        "own_dir",
        F.posexplode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")))).alias("depth", "dir"),
    )
    inherited = (
        above.join(dirs, "dir")
        .groupBy("own_dir")
        .agg(F.max_by(F.struct("dir", "dir_license", "dir_cosine"), "depth").alias("near"))
    )
    judged = (
        base.select("file_id", "path", "key", directory.alias("own_dir"))
        .join(headers, "key", "left")
        .join(licence_files.select("key", "file", "file_cosine"), "key", "left")
        .join(inherited, "own_dir", "left")
    )
    how = (
        F.when(F.col("file").isNotNull(), "file")
        .when(F.col("header").isNotNull(), "header")
        .when(F.col("near").isNotNull() & F.col("path").isNotNull(), "inherited")
        .otherwise("none")
    )
    pick = lambda a, b, c: F.when(F.col("how") == "file", a).when(F.col("how") == "header", b).when(F.col("how") == "inherited", c)
    return judged.withColumn("how", how).select(
        "file_id",
        "path",
        pick(F.col("file"), F.col("header"), F.col("near.dir_license")).alias("license"),
        pick(F.col("file_cosine"), F.col("header_cosine"), F.col("near.dir_cosine")).alias("cosine"),
        "how",
        F.when(F.col("how") == "inherited", F.col("near.dir")).alias("from_dir"),
    )
