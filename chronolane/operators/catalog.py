"""Dimension of named things: aliases, exact and fuzzy resolution, declared actions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronolane.functions.fuzzy import Phrases
from chronolane.functions.text import casefold
from chronolane.sources.shared import written

from . import ranks


def expand_aliases(entries: DataFrame, translations: dict[str, str]) -> DataFrame:
    """(entry_id, alias, kind): the name, the localized name if any, and one ``name [color]`` for each reload color.

    A color without translation is an error.
    """
    table = F.create_map(*[F.lit(x) for pair in translations.items() for x in pair])
    colored = F.transform(
        F.coalesce("reload_colors", F.array().cast("array<string>")),
        lambda c: F.struct(
            F.concat("name", F.lit(" ["), F.coalesce(F.try_element_at(table, c), F.raise_error(F.concat(F.lit("no translation: "), c)).cast("string")), F.lit("]")).alias("alias"),
            F.lit("reload").alias("kind"),
        ),
    )
    own = F.array(F.struct(F.col("name").alias("alias"), F.lit("name").alias("kind")))
    local = F.when(F.col("localized").isNotNull(), F.array(F.struct(F.col("localized").alias("alias"), F.lit("localized").alias("kind")))).otherwise(
        F.array().cast("array<struct<alias:string,kind:string>>")
    )
    return entries.select("entry_id", F.explode(F.concat(own, local, colored)).alias("a")).select("entry_id", "a.alias", "a.kind")


def conflicts(aliases: DataFrame) -> DataFrame:
    """(alias, owners): folded aliases that more than one entry claims."""
    return aliases.groupBy(casefold(F.col("alias")).alias("alias")).agg(F.count_distinct("entry_id").alias("owners")).where("owners > 1")


def unique(aliases: DataFrame) -> DataFrame:
    """``aliases``, checked: an alias that two entries claim is an error that names it."""
    claimed = [r["alias"] for r in conflicts(aliases).orderBy("alias").limit(5).collect()]
    if claimed:
        raise ValueError(f"aliases with more than one entry: {', '.join(claimed)}")
    return aliases


def resolve(rows: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """``rows`` with entry_id of the exact alias, case folded; null if none. Aliases that two entries claim are an error (``unique``)."""
    known = unique(aliases).groupBy(casefold(F.col("alias")).alias("_folded")).agg(F.min("entry_id").alias("entry_id"))
    return rows.withColumn("_folded", casefold(F.col(text))).join(known, "_folded", "left").drop("_folded")


def action(labels: Column, label: Column, ratio: Column) -> Column:
    """The action of a press: none without labels, the only label, else the held label if it is close enough."""
    return F.when(labels.isNull() | (F.size(labels) == 0), None).when(F.size(labels) == 1, F.get(labels, F.lit(0))).when(ratio >= 55, label)


#: Texts and aliases that meet in one task.
ASKED, LISTED = 256, 2048


def _tiles(rows: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """``rows`` (key, text) by length, in tiles of ``most``: (tile, least, longest, own), own an array of (key, text)."""
    placed = ranks.numbered(rows.select(key, text, F.length(text).alias("_n")), [F.col("_n"), F.col(text), F.col(key)])
    tile = F.floor((F.col("place") - 1) / most).alias("tile")
    return placed.groupBy(tile).agg(F.min("_n").alias("least"), F.max("_n").alias("longest"), F.collect_list(F.struct(F.col(key).alias("key"), F.col(text).alias("text"))).alias("own"))


def match(asked: DataFrame, aliases: DataFrame, least: float = 70) -> DataFrame:
    """(asked, entry_id, score, margin) for every text of ``asked`` (asked, text) that an alias (entry_id, alias) is like by ``least`` or more.

    score: the exact ratio of the best entry, of equals the smallest; margin: its lead
    over the next entry that reaches ``least``, null without one. Texts and aliases are
    tiled by length, and only tiles whose lengths can reach the ratio meet: twice the
    shorter of both is at least ``least`` percent of their sum. In a pair of tiles a text
    meets all aliases in one pass, and the two best entries come out.
    """
    part = least / 100
    texts = written(_tiles(asked, "asked", "text", ASKED))
    names = written(_tiles(aliases.select("entry_id", "alias"), "entry_id", "alias", LISTED))
    # A shorter one of m letters fits up to m * (2 - part) / part; with a little room for rounding.
    low, high = F.ceil(F.col("least") * part / (2 - part) - 1e-6), F.floor(F.col("longest") * (2 - part) / part + 1e-6)
    lengths = names.select(F.col("tile").alias("block"), F.explode(F.sequence(low, high)).alias("_n"))
    pairs = texts.select("tile", F.explode(F.sequence(F.col("least").cast("long"), F.col("longest").cast("long"))).alias("_n")).join(lengths, "_n").select("tile", "block").distinct()
    both = pairs.join(texts.select("tile", F.col("own").alias("texts")), "tile").join(names.select(F.col("tile").alias("block"), F.col("own").alias("names")), "block")
    kinds = {"asked": asked.schema["asked"].dataType, "entry_id": aliases.schema["entry_id"].dataType}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in range(batch.num_rows):
                listed = batch.column(1)[block].as_py()
                many, sizes = Phrases([x["text"] for x in listed]), np.array([len(x["text"]) for x in listed])
                out = []
                for x in batch.column(0)[block].as_py():
                    whole = sizes + len(x["text"])
                    ratio = np.where(whole == 0, 100.0, 200.0 * np.array(many.common(x["text"])) / np.maximum(whole, 1))
                    best: dict = {}
                    for i in np.flatnonzero(ratio >= least):
                        best[listed[i]["key"]] = max(best.get(listed[i]["key"], 0.0), float(ratio[i]))
                    out += [(x["key"], key, score) for key, score in sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[:2]]
                columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((to_arrow_type(kinds["asked"]), to_arrow_type(kinds["entry_id"]), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["asked", "entry_id", "score"])

    scored = both.select("texts", "names").mapInArrow(run, f"asked {kinds['asked'].simpleString()}, entry_id {kinds['entry_id'].simpleString()}, score double")
    return top_and_margin(scored, ["asked"])


def top_and_margin(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, entry_id, score, margin): the best entry, and how far the next one is behind (null without a next)."""
    best = scored.groupBy(*by, "entry_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "entry_id")
    return (
        best.select(*by, "entry_id", "score", F.row_number().over(w).alias("_n"), (F.col("score") - F.lead("score").over(w)).alias("margin"))
        .where("_n = 1")
        .drop("_n")
    )
