"""Logs that are still written, read as a stream by byte offset.

The offset is the size of each open file; a batch is the bytes between two offsets,
dealt out in ranges. A line belongs to the range that holds its line end, so a line
that is torn at the end of a file waits until the rest is there, every line is read
once, and a batch that is run again reads the same bytes, whatever the files have grown
to. The driver lists files and reads none. Files only grow; one that is shorter than
before is read anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import stores

SCHEMA = "name string, at long, value string"
RANGE = 64 << 20
CHUNK = 1 << 20


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def lines_between(file, start: int, end: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines whose ends lie in [start, end) of a file that can seek; blank lines are left out."""
    at = start
    while at > 0:  # back to where the line begins that start is in
        low = max(0, at - chunk)
        file.seek(low)
        cut = file.read(at - low).rfind(b"\n")
        if cut >= 0:
            at = low + cut + 1
            break
        at = low
    file.seek(at)
    begin, parts = at, []
    while at < end:
        data = file.read(min(chunk, end - at))
        if not data:
            return
        *whole, rest = data.split(b"\n")
        for piece in whole:
            line = b"".join([*parts, piece])
            if line.strip():
                yield begin, line
            begin, parts = begin + len(line) + 1, []
        parts.append(rest)
        at += len(data)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, most: int) -> None:
        self.path, self.suffix, self.most = path, suffix, most

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return stores.listed(self.path, self.suffix)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, size in sorted(end.items()):
            at = start.get(file, 0)
            at = 0 if size < at else at
            out += [Range(file, s, min(s + self.most, size)) for s in range(at, size, self.most)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = stores.opened(self.path)
        with store.open_input_file(partition.file) as file:
            for at, line in lines_between(file, partition.start, partition.end):
                yield partition.file, at, line.decode("utf-8", "replace")


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chronolane_growing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("rangeBytes", RANGE)))


def read(spark: SparkSession, path: str, suffix: str = ".jsonl", range_bytes: int = RANGE) -> DataFrame:
    """A stream of (name, at, value): the lines of the files under ``path`` as they come, ``at`` their byte offset."""
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format("chronolane_growing").option("path", path).option("suffix", suffix).option("rangeBytes", str(range_bytes)).load()


def observations(lines: DataFrame) -> DataFrame:
    """The typed observations of a stream of lines; pos is the line's byte offset, other kinds of lines are left out."""
    from pyspark.sql import functions as F

    from . import jsonl

    parsed = lines.select(F.col("name").alias("file"), F.col("at").alias("pos"), "value", F.from_json("value", jsonl.WIRE).alias("parsed"))
    return jsonl.observations(parsed.withColumn("kind", jsonl.line_kind(F.col("parsed"))))
