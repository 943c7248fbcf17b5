"""Snapshots of a table that is kept up to date: each is written whole beside the others, the newest whole one counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Snapshots that stay, for readers that have begun.
STAY = 2


def _snapshots(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(time, path) of the whole ones, the newest last."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(folder)
    store = base.getFileSystem(conf)
    if not store.exists(base):
        return []
    marks = [jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS") for s in store.listStatus(base)]
    return sorted((store.getFileStatus(m).getModificationTime(), m.getParent().toString()) for m in marks if store.exists(m))


def newest(spark: SparkSession, folder: str) -> DataFrame | None:
    found = _snapshots(spark, folder)
    return spark.read.parquet(found[-1][1]) if found else None


def kept(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` as the newest snapshot; older ones but ``STAY`` go."""
    spark = rows.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    for _, old in _snapshots(spark, folder)[:-STAY]:
        where = spark._jvm.org.apache.hadoop.fs.Path(old)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return spark.read.parquet(path)
