"""Tables in the folder that driver and executors share, to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table under ``spark.checkpoint.dir``, read again.

    Lost executors lose nothing, and later plans start from the table. Where the
    session names no folder, a session on one machine gets a temporary one and a
    cluster an error. Tables stay until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/chronolane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
