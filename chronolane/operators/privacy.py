"""Privacy screening: texts that match templates, their episodes, and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.functions.fuzzy import best_phrase
from chronolane.functions.text import normalized
from chronolane.model import LOG, POS, TIME

from .temporal import asof

THRESHOLD, TAIL_LEAST = 80, 10


def template_tail(template: Column) -> Column:
    """What follows a template's last placeholder; null without one."""
    return F.when(template.rlike(r"\{[^}]*\}"), F.regexp_extract(template, r"(?s).*\{[^}]*\}(.*)\z", 1))


def template_errors(templates: DataFrame) -> DataFrame:
    """(template_id, problem) for a repeated id or tail, upper case, no placeholder, and a tail under ten characters."""
    tail = template_tail(F.col("template"))
    seen = templates.withColumn("tail", tail).withColumn("_ids", F.count(F.lit(1)).over(Window.partitionBy("template_id"))).withColumn(
        "_tails", F.count(F.lit(1)).over(Window.partitionBy("tail"))
    )
    problem = (
        F.when(F.col("_ids") > 1, "repeated id")
        .when(F.col("tail").isNull(), "no placeholder")
        .when(F.col("template") != F.lower("template"), "not lower case")
        .when(F.length(F.trim("tail")) < TAIL_LEAST, "short tail")
        .when(F.col("_tails") > 1, "repeated tail")
    )
    return seen.select("template_id", problem.alias("problem")).where("problem is not null")


def best_template(rows: DataFrame, text: str, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``rows`` with the struct ``hit`` (template_id, score) of the best template, the first of equals; null if none reaches the threshold.

    ``templates``: (template_id, ord, tail), a short list that is checked and sent
    along in one bit vector; a text meets all of them in one pass, and only those that
    can reach the threshold are compared window by window.
    """
    listed = [(r["template_id"], r["tail"]) for r in templates.orderBy("ord").limit(1001).collect()]
    if len(listed) > 1000:
        raise ValueError("more than 1000 templates")
    if not listed:
        return rows.withColumn("hit", F.lit(None).cast("struct<template_id:string,score:double>"))
    names = F.array(*[F.lit(i).cast("string") for i, _ in listed])
    found = rows.withColumn("_hit", best_phrase(normalized(F.col(text)), [tail for _, tail in listed], threshold))
    named = F.struct(F.get(names, F.col("_hit.place")).alias("template_id"), F.col("_hit.score").alias("score"))
    return found.withColumn("hit", F.when(F.col("_hit").isNotNull(), named)).drop("_hit")


def episodes(reads: DataFrame, by: list[str], read: list[str] = (POS,)) -> DataFrame:
    """(by, hit_id, first_us, last_us, reads, score): consecutive reads of a column that hit one template.

    ``reads``: every read of the column with hit_id (null: none) and score; several
    rows may be one read, told by the columns ``read``. A read without the hit closes
    the episode.
    """
    w = Window.partitionBy(*by).orderBy(TIME, *read)
    numbered = reads.withColumn("_n", F.dense_rank().over(w))
    hit = numbered.where("hit_id is not null")
    own = Window.partitionBy(*by, "hit_id").orderBy("_n")
    grouped = hit.withColumn("_isl", F.col("_n") - F.row_number().over(own))
    return grouped.groupBy(*by, "hit_id", "_isl").agg(
        F.min(TIME).alias("first_us"), F.max(TIME).alias("last_us"), F.count(F.lit(1)).alias("reads"), F.max("score").alias("score")
    ).drop("_isl")


def snapped(found: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """``found`` with start_us, the grid time before first_us, and end_us, the one after last_us, both strictly.

    Without one before, the episode starts at its first read; without one after,
    it ends one mean grid spacing past its last read.
    """
    spacing = grid.groupBy(LOG).agg(
        F.when(F.count(F.lit(1)) > 1, F.floor((F.max(TIME) - F.min(TIME)) / (F.count(F.lit(1)) - 1))).otherwise(F.lit(0)).alias("spacing")
    )
    keyed = found.withColumn(POS, F.lit(0).cast("long"))
    ticks = grid.select(LOG, TIME, POS).withColumn("tick", F.col(TIME))
    start = asof(keyed.withColumn(TIME, F.col("first_us")), ticks, [LOG], ["tick"], inclusive=False).withColumn("start_us", F.coalesce("got.tick", "first_us")).drop("got")
    end = asof(start.withColumn(TIME, F.col("last_us")), ticks, [LOG], ["tick"], inclusive=False, forward=True)
    return (
        end.join(spacing, LOG, "left")
        .withColumn("end_us", F.coalesce("got.tick", F.col("last_us") + F.coalesce("spacing", F.lit(0))))
        .drop("got", "spacing", TIME, POS)
    )


def mask(text: Column, template_id: Column) -> Column:
    return F.when(template_id.isNotNull(), F.concat(F.lit("masked:"), template_id)).otherwise(text)
