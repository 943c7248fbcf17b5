"""Logs that are still written: a stream appends lines, readers see them at once, a batch job seals them.

``append`` is a plain text sink: each micro-batch adds files under the log's
folder, so a log can be read (``jsonl.read_lines``) while it grows, and a restart
from the checkpoint writes no line twice. ``seal`` turns a finished folder into
sealed logs with header and footer; the folder itself is left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronolane.model import LOG, POS
from chronolane.sources import jsonl


def append(obs: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start writing a stream of observations as lines under ``path``, one folder for each log; ``trigger`` as in ``DataStreamWriter.trigger``."""
    line = jsonl.encode(obs)
    out = line.select(LOG, F.to_json(F.struct(F.col(POS).alias("pos"), F.col("value").alias("line"))).alias("value"))
    writer = out.writeStream.format("text").partitionBy(LOG).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The observations appended so far; log_id is the log's folder."""
    lines = spark.read.schema(f"value string, {LOG} string").text(path)
    inner = F.from_json("value", "pos BIGINT, line STRING")
    parsed = lines.select(LOG, inner.alias("x")).select(F.col(LOG).alias("file"), "x.pos", F.col("x.line").alias("value"))
    parsed = parsed.withColumn("parsed", F.from_json("value", jsonl.WIRE)).withColumn("kind", jsonl.line_kind(F.col("parsed")))
    return jsonl.observations(parsed)


def seal(spark: SparkSession, path: str, to: str) -> None:
    """Write what was appended under ``path`` as sealed logs under ``to``, each in the order of its rows."""
    jsonl.write_logs(read(spark, path), to)
