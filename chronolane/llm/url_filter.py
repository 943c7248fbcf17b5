"""URL filtering by association rules, in DataFrame and Spark ML functions only.

Frequent combinations of URL tokens are mined by FP-growth from labelled URLs;
combinations that point to the label ``block`` with enough support, confidence
and lift are rules. A URL meets rules by an inverted index: each rule is filed
under its rarest token, and URLs with equal token sets are looked up once. Fixed
rules on host and path come first.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BLOCK = "label=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: on to ``?``, ``#`` or the end. Empty for null or no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule (verdict, host, path) that fits, else null."""
    out: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p) & (host != "")
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens: labels of the host and their hyphened parts, the last two labels, the path's words without numbers, its ending, keys of the query, a fragment."""
    host, path = host_and_path(url)
    labels = F.split(host, r"\.")
    words = F.filter(F.split(path, r"[^\p{L}]+"), lambda w: F.length(w) > 1)
    query = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"\A([^=]*)", 1))

    def named(kind: str, xs: Column) -> Column:
        return F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))

    parts = [
        named("host", labels),
        named("word", F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))),
        named("site", F.array(F.regexp_extract(host, r"([^.]+\.[^.]+)\z", 1))),
        named("path", words),
        named("key", keys),
        F.when(F.coalesce(url.cast("string"), F.lit("")).contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def mine(labelled: DataFrame, support: float = 0.001, confidence: float = 0.5, lift: float = 2.0, least_rows: int = 20) -> DataFrame:
    """(items, confidence, support, lift): rules for ``block`` from ``labelled`` (url, blocked boolean; null labels are skipped).

    A rule needs ``support`` as a share of the labelled rows and ``least_rows`` of
    them; fewer rows than that give no rules.
    """
    empty = labelled.sparkSession.createDataFrame([], "items array<string>, confidence double, support double, lift double")
    known = labelled.where("blocked is not null").select(tokens(F.col("url")).alias("t"), "blocked").where("size(t) > 0")
    baskets = written(known.select(F.when(F.col("blocked"), F.concat("t", F.array(F.lit(BLOCK)))).otherwise(F.col("t")).alias("items")))
    n = baskets.count()
    if n < least_rows:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=max(support, least_rows / n), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where((F.col("consequent")[0] == BLOCK) & (F.col("lift") >= lift))
    return rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support", "lift")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token_set, n_rules): for each distinct token set of ``urls`` (column t) that a rule fits, how many do."""
    sets = urls.select("t").distinct().withColumn("token_set", F.xxhash64("t"))
    each = sets.select("token_set", "t", F.explode("t").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = (
        rules.select("items", F.explode("items").alias("token"))
        .join(counts, "token")
        .groupBy("items")
        .agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    )
    hits = each.join(filed, "token").where(F.size(F.array_except("items", "t")) == 0)
    return hits.groupBy("token_set").agg(F.count_distinct("items").alias("n_rules"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, n_rules) for every row of ``pages``.

    A fixed rule's verdict holds if one fits; else ``block`` if a mined rule fits
    and ``allow`` if not. Null URLs have empty host and path and are allowed.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("t"))
    found = matched(parsed, mine(labelled))
    fixed = fixed_rule(F.col("host"), F.col("path"), rules)
    return (
        parsed.withColumn("token_set", F.xxhash64("t"))
        .join(found, "token_set", "left")
        .withColumn("fixed", fixed)
        .select(
            id_col,
            "host",
            "path",
            F.col("fixed.rule").alias("rule"),
            F.coalesce(F.col("fixed.verdict"), F.when(F.col("n_rules") > 0, "block").otherwise("allow")).alias("verdict"),
            F.coalesce("n_rules", F.lit(0).cast("long")).alias("n_rules"),
        )
    )
