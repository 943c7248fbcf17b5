"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that the operators use inside their plans; extra columns of an input never get this far.
DOC_ID, TEXT = "doc_id", "text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine gets a temporary
    folder; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: the lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronolane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that no plan reads any more."""
    path = getattr(df, "_written_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def texts(docs: DataFrame, id_col: str = DOC_ID, text_col: str = TEXT) -> DataFrame:
    """Only id and text, a null text read as empty."""
    return docs.select(
        F.col(id_col).alias(DOC_ID), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(TEXT)
    )


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; when the task ends, memory that its worker no longer uses goes back to the system.

    Spark keeps workers for the stages that follow; without this each stays as
    large as its largest task was.
    """

    @wraps(run)
    def runs(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return runs


def hand_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Rows of whole documents go to Python a few hundred at a time, so that long texts don't pile up in a worker; shuffles go when the write that they were for has ended."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
