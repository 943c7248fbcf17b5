"""Sealed logs that tell where their tail is, and the few bytes of each log that an inventory needs.

A sealed log is one gzip file of members: header line, body, appendix line (if
any), footer line. An extra field of the first member holds the compressed sizes
of the last two, so an inventory reads three small ranges of a file instead of
all of it. Ranges are read on executors with Arrow's file systems; a store that
only Spark opens is read whole (``by_content``).
"""

from __future__ import annotations

import gzip
import io
import itertools
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stores

#: Fixed values of the file format: the name of the extra subfield and its length in bytes.
SUBFIELD, SUBFIELD_BYTES = b"HU", 8
#: Bytes read of a file's head, and of the end of a log that is still written.
HEAD, TAIL = 1 << 16, 1 << 20
EDGES = "name string, first string, second_last string, last string"


def member(payload: bytes, extra: bytes = b"") -> bytes:
    """One gzip member without a time, so that equal payloads are equal bytes."""
    whole = gzip.compress(payload, mtime=0)
    if not extra:
        return whole
    return whole[:3] + bytes([whole[3] | 4]) + whole[4:10] + struct.pack("<H", len(extra)) + extra + whole[10:]


def ends(header: bytes, appendix: bytes | None, footer: bytes) -> tuple[bytes, bytes]:
    """What goes before and after the body of a sealed log; the lines come without their ends."""
    tail = [b"" if appendix is None else member(appendix + b"\n"), member(footer + b"\n")]
    sizes = struct.pack("<II", *map(len, tail))
    return member(header + b"\n", SUBFIELD + struct.pack("<H", len(sizes)) + sizes), b"".join(tail)


def packed(header: bytes, body: bytes, appendix: bytes | None, footer: bytes) -> bytes:
    """A sealed log; ``body`` is whole lines, the others one line each without its end."""
    head, tail = ends(header, appendix, footer)
    return head + member(body) + tail


def extra_fields(head: bytes) -> dict[bytes, bytes]:
    """The extra fields of a gzip header by name (RFC 1952, 2.3.1.1); none if there are none, or the header isn't whole."""
    source, out = io.BytesIO(head), {}
    start = source.read(10)
    if start[:3] != b"\x1f\x8b\x08" or not start[3:4] or not start[3] & 0b100:
        return out
    (left,) = struct.unpack("<H", source.read(2).ljust(2, b"\0"))
    source = io.BytesIO(source.read(left))
    for name in iter(lambda: source.read(2), b""):
        size = int.from_bytes(source.read(2), "little")
        value = source.read(size)
        if len(value) == size:
            out[name] = value
    return out


def tail_sizes(head: bytes) -> tuple[int, int] | None:
    """Compressed sizes of appendix (0: none) and footer, from a file's first bytes; None if they are not told."""
    told = extra_fields(head).get(SUBFIELD, b"")
    return struct.unpack("<II", told) if len(told) == SUBFIELD_BYTES else None


def head_line(head: bytes) -> bytes | None:
    """The first line that a file's first bytes unpack to; None if its end is not among them."""
    try:
        line, end, _ = zlib.decompressobj(wbits=31).decompress(head).partition(b"\n")
    except zlib.error:
        return None
    return line if end else None


def _lines(source) -> Iterator[bytes]:
    """The lines of a stream that are not blank, without white space around them."""
    return filter(None, map(bytes.strip, source))


def edges(file, size: int, packed_: bool) -> tuple[bytes, bytes, bytes]:
    """First line and last two lines that are not blank, of a file that can seek; a missing line is empty.

    Of a log with a pointer the second last is its appendix, empty if it has none;
    head and tail are read. Of a plain file head and end are read, a gzip file without
    a pointer is read through, one line at a time.
    """

    def part(start: int, end: int) -> bytes:
        file.seek(start)
        return file.read(end - start)

    head = part(0, min(size, HEAD))
    told = tail_sizes(head) if packed_ else None
    first = head_line(head) if told else None
    if first is not None:
        tail = gzip.decompress(part(size - sum(told), size)).splitlines()
        last = deque(_lines(tail), maxlen=2 if told[0] else 1)
    elif packed_:
        file.seek(0)
        rest = _lines(gzip.GzipFile(fileobj=file))
        first = next(rest, b"")
        last = deque(itertools.chain([first] if first else [], rest), maxlen=2)
    else:
        first = head.partition(b"\n")[0].strip()
        start = max(0, size - TAIL)
        # A window that begins inside a line begins with a part of one.
        last = deque(_lines(part(start, size).split(b"\n")[start > 0 :]), maxlen=2)
    return first, *[b""] * (2 - len(last)), *last


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, modified, size) of the files under ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def edge_lines(files: DataFrame, by_content: bool = False) -> DataFrame:
    """(name, first, second_last, last) of each file of ``files`` (name, size; content if ``by_content``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lines = batch.column(0).to_pylist(), []
            for name, size, content in zip(names, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if by_content:
                    lines.append(edges(io.BytesIO(content), size, name.endswith(".gz")))
                    continue
                store, at = stores.opened(name)
                with store.open_input_file(at) as file:
                    lines.append(edges(file, size, name.endswith(".gz")))
            columns = [pa.array([x[i].decode("utf-8", "replace") for x in lines], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], names=["name", "first", "second_last", "last"])

    content = F.col("content") if by_content else F.lit(None).cast("binary")
    return files.select("name", "size", content.alias("content")).mapInArrow(run, EDGES)


def sha256(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the files under ``path``, lowercase hex."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("name"), F.sha2("content", 256).alias("sha256"))
