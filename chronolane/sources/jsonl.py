"""Observation logs as JSON lines: one header, the observations, then an appendix and a footer if the log is sealed.

Plain and gzip text, one file a log. A line's kind shows in the key that holds
its format version; a line without one is an observation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolane.model import LOG, LOG_VERSION, POS, TIME, checked_signal, micros

from . import sealed

KINDS = {"log_version": "header", "intervals_version": "appendix", "observations": "footer"}
WIRE = "t DOUBLE, f BIGINT, s STRING, k ARRAY<STRING>, v STRING, c DOUBLE, log_version INT, intervals_version INT, observations BIGINT"


def line_kind(parsed: Column) -> Column:
    out: Column = F.lit("observation")
    for key, kind in KINDS.items():
        out = F.when(parsed[key].isNotNull(), kind).otherwise(out)
    return out


def encode(obs: DataFrame) -> DataFrame:
    """(log_id, pos, t_us, value): observations as wire lines. A null value is written, not left out."""
    line = F.to_json(
        F.struct(
            (F.col(TIME) / 1_000_000.0).alias("t"), F.col("frame").alias("f"), F.col("signal").alias("s"), F.col("key").alias("k"), F.col("value").alias("v"), F.col("score").alias("c")
        ),
        {"ignoreNullFields": "false"},
    )
    return obs.select(LOG, POS, TIME, line.alias("value"))


def write_logs(obs: DataFrame, path: str, extras: DataFrame | None = None) -> None:
    """One sealed log for each log_id under ``path``: header, observations by pos, footer that counts them, and a pointer to the tail.

    ``extras``: (log_id, step, line), lines of ``sealed.HEADER``, ``APPENDIX`` or ``FOOTER``
    (a JSON object that joins the counts), at most one of each for a log.
    """
    void = F.lit(None).cast("long")
    line = encode(obs)
    body = line.select(LOG, F.lit(sealed.BODY).alias("step"), TIME, POS, F.col("value").alias("line"))
    if extras is not None:
        body = body.unionByName(extras.select(F.col(LOG).cast(obs.schema[LOG].dataType).alias(LOG), "step", void.alias(TIME), void.alias(POS), "line"))
    sealed.write(body, path)


def write_plain_logs(obs: DataFrame, path: str) -> None:
    """One gzip file for each log under ``path``, sealed with a footer that counts the observations, without a pointer: for stores that only Spark opens."""
    head = obs.select(LOG).distinct().select(
        LOG, F.lit(-1).cast("long").alias(POS), F.to_json(F.struct(F.lit(LOG_VERSION).alias("log_version"))).alias("value")
    )
    foot = obs.groupBy(LOG).agg(F.count(F.lit(1)).alias("observations"), F.max(TIME).alias("last_us")).select(
        LOG, F.lit((1 << 62)).alias(POS), F.to_json(F.struct("observations", "last_us")).alias("value")
    )
    lines = head.unionByName(encode(obs).drop(TIME)).unionByName(foot)
    lines.repartition(LOG).sortWithinPartitions(LOG, POS).select(LOG, "value").write.partitionBy(LOG).option("compression", "gzip").text(path)


def path_of(file: Column) -> Column:
    """A file's path as listings tell it, from the URI that lines carry."""
    plain = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")


def _seen(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value"
    ).where(F.trim("value") != "")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, pos, value, kind, parsed): the lines of all logs under ``path`` that are not blank, in order.

    A gzip file is read by one task, so ids rise along the file; plain files are
    ordered by the offset of their split first.
    """
    seen = _seen(spark, path)
    pos = F.row_number().over(Window.partitionBy("file").orderBy("_at", "_id")) - 1
    parsed = F.from_json("value", WIRE)
    return seen.select("file", pos.cast("long").alias(POS), "value", parsed.alias("parsed")).withColumn("kind", line_kind(F.col("parsed")))


def observations(lines: DataFrame) -> DataFrame:
    """The typed observations; an unknown signal is an error."""
    p = F.col("parsed")
    return lines.where("kind = 'observation'").select(
        F.col("file").alias(LOG),
        POS,
        micros(p["t"]).alias(TIME),
        p["f"].alias("frame"),
        checked_signal(p["s"]).alias("signal"),
        p["k"].alias("key"),
        p["v"].alias("value"),
        p["c"].alias("score"),
    )


def broken(lines: DataFrame) -> DataFrame:
    """(file, problem) for logs whose first line is no header or whose version is another."""
    first = lines.groupBy("file").agg(F.min_by("kind", POS).alias("kind"), F.min_by(F.col("parsed.log_version"), POS).alias("version"))
    problem = F.when(F.col("kind") != "header", "no header").when(F.col("version") != LOG_VERSION, "version")
    return first.select("file", problem.alias("problem")).where("problem is not null")


def edge_lines(lines: DataFrame) -> DataFrame:
    """(file, first, second_last, last): what an inventory needs of a log."""
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc(POS)))
    return (
        lines.withColumn("_n", last)
        .groupBy("file")
        .agg(
            F.min_by("value", POS).alias("first"),
            F.max(F.when(F.col("_n") == 2, F.col("value"))).alias("second_last"),
            F.max(F.when(F.col("_n") == 1, F.col("value"))).alias("last"),
        )
    )


def read_edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``edge_lines`` of all logs under ``path``: each task keeps the first and the last two lines of what it reads of a file, and only those are sorted."""
    kept = _seen(spark, path).mapInArrow(_edges, "file string, _at long, _id long, value string")
    pos = F.row_number().over(Window.partitionBy("file").orderBy("_at", "_id"))
    return edge_lines(kept.select("file", pos.alias(POS), "value"))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task reads a split's lines in order, one split after the other."""
    split, held = None, None
    for batch in batches:
        own = list(zip(batch["file"].to_pylist(), batch["_at"].to_pylist()))
        cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            part = pa.Table.from_batches([batch.slice(start, stop - start)])
            if split == own[start]:
                part = pa.concat_tables([held, part])
            elif held is not None:
                yield from held.to_batches()
            n = part.num_rows
            split, held = own[start], part.take(sorted({0, max(0, n - 2), n - 1}))
    if held is not None:
        yield from held.to_batches()


def changed(now: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or have another time or size than ``known`` has."""
    return now.join(known, ["name", "modified", "size"], "left_anti")


def refreshed(now: DataFrame, known: DataFrame, fresh: DataFrame) -> DataFrame:
    """The inventory after a scan: known rows of unchanged files, fresh ones for the rest."""
    return known.join(now, ["name", "modified", "size"], "left_semi").unionByName(fresh)


#: Fixed field names of header, appendix and footer lines.
HEADER = (
    "log_version INT, version STRING, created_at STRING, video STRUCT<filename: STRING, width: INT, height: INT, codec: STRING, sha256: STRING, frame_rate: DOUBLE, duration_s: DOUBLE>,"
    " requested ARRAY<STRING>, signals ARRAY<STRING>, rates MAP<STRING, DOUBLE>, batch_size INT, device STRING, models MAP<STRING, STRUCT<file: STRING, sha256: STRING, threshold: DOUBLE>>,"
    " engines MAP<STRING, STRUCT<used_by: ARRAY<STRING>, model: STRING, locale: STRING>>, corrections ARRAY<MAP<STRING, STRING>>"
)
APPENDIX = "intervals_version INT, intervals ARRAY<STRING>"
FOOTER = "observations BIGINT, frames_sampled BIGINT, achieved_fps DOUBLE, runtime_s DOUBLE, summary_version INT, summary STRING"


def header(line: Column) -> Column:
    """A header line as a struct; another version than ``LOG_VERSION``, or a line that is no header, is an error."""
    read = F.from_json(line, HEADER)
    problem = F.concat(F.lit("no header, or an unsupported log version: "), F.coalesce(F.substring(line, 1, 80), F.lit("")))
    return F.when(read["log_version"] == LOG_VERSION, read).otherwise(F.raise_error(problem).cast(f"struct<{HEADER}>"))


def appendix(line: Column, version: int) -> Column:
    """An appendix line as a struct; null if the line is none or its version another."""
    read = F.from_json(line, APPENDIX)
    return F.when(read["intervals_version"] == version, read)


def footer(line: Column) -> Column:
    """A footer line as a struct; null if the line is none."""
    read = F.from_json(line, FOOTER)
    return F.when(read["observations"].isNotNull(), read)


def locale(head: Column) -> Column:
    """The catalog locale that a log (its header struct) was written with, ``en`` if it names none."""
    return F.coalesce(F.try_element_at(head["engines"], F.lit("catalog"))["locale"], F.lit("en"))


def confined(name: Column) -> Column:
    """Whether a name stays inside its archive: a relative path without ``..`` steps, not empty."""
    return F.coalesce((F.length(name) > 0) & ~name.startswith("/") & ~F.array_contains(F.split(name, "/"), ".."), F.lit(False))
