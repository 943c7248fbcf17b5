"""Sealed logs as a data source that Spark writes: one gzip file of members for each log, with a pointer to its tail.

Each task streams its logs, sorted, into files of its own under ``_open-<job>``; memory
does not grow with a log. Only when all tasks have ended are the files moved to
``log_id=<name>/log.gz``, so a log is there whole or not at all, and a task that runs
twice leaves one log. When a job fails, what it had written stays under ``_open-<job>``,
where readers don't look, to be inspected or removed.

Paths are opened with Arrow's file systems; a store that only Spark opens takes
``jsonl.write_plain_logs``, whose files have no pointer.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from chronolane.model import LOG, LOG_VERSION, POS, TIME

from . import stores, tails

HEADER, BODY, APPENDIX, FOOTER = range(4)
CHUNK = 1 << 20


class _Log:
    """One log that is being written: its body goes to a file, the few other lines are kept."""

    def __init__(self, store, folder: str, name: str) -> None:
        self.store, self.at, self.name = store, f"{folder}/{quote(name, safe='')}", name
        self.sink = store.open_output_stream(f"{self.at}.body", compression=None)
        self.body = gzip.GzipFile(filename="", mode="wb", fileobj=self.sink, mtime=0)
        self.lines: dict[int, bytes] = {HEADER: json.dumps({"log_version": LOG_VERSION}, separators=(",", ":")).encode()}
        self.count, self.last_us = 0, None

    def add(self, step: int, t_us: int | None, line: str) -> None:
        if step == BODY:
            self.body.write(line.encode() + b"\n")
            self.count += 1
            self.last_us = t_us if self.last_us is None or (t_us is not None and t_us > self.last_us) else self.last_us
        else:
            self.lines[step] = line.encode()

    def sealed(self) -> tuple[str, str]:
        """Write the whole file beside the body; where it is, and where it belongs."""
        self.body.close()
        self.sink.close()
        footer = {"observations": self.count, "last_us": self.last_us} | json.loads(self.lines.get(FOOTER, b"{}"))
        head, tail = tails.ends(self.lines[HEADER], self.lines.get(APPENDIX), json.dumps(footer, separators=(",", ":")).encode())
        with self.store.open_output_stream(f"{self.at}.gz", compression=None) as out:
            out.write(head)
            with self.store.open_input_stream(f"{self.at}.body", compression=None) as body:
                while chunk := body.read(CHUNK):
                    out.write(chunk)
            out.write(tail)
        self.store.delete_file(f"{self.at}.body")
        return f"{self.at}.gz", f"log_id={quote(self.name, safe='')}/log.gz"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SealedWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        store, base = stores.opened(self.path)
        folder = f"{base}/_open-{self.job}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(folder)
        log, done = None, []
        for batch in iterator:
            for name, step, t_us, line in zip(*(batch.column(c).to_pylist() for c in (LOG, "step", TIME, "line"))):
                if log is None or log.name != name:
                    done += [log.sealed()] if log else []
                    log = _Log(store, folder, name)
                log.add(step, t_us, line)
        done += [log.sealed()] if log else []
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = stores.opened(self.path)
        for file, to in (f for m in messages if m is not None for f in m.files):
            store.create_dir(f"{base}/{to.rpartition('/')[0]}")
            store.move(file, f"{base}/{to}")
        store.delete_dir(f"{base}/_open-{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing has a name that readers look for; what was written stays where it is."""


class SealedLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chronolane_sealed"

    def writer(self, schema, overwrite: bool) -> SealedWriter:
        if overwrite:
            raise ValueError("sealed logs are added, never overwritten")
        return SealedWriter(self.options["path"])


def write(lines: DataFrame, path: str) -> None:
    """Write (log_id, step, t_us, pos, line) as sealed logs under ``path``: of each log a header (one is made if there is none), observations by pos, an appendix if any, and a footer, to whose JSON the counts are added."""
    lines.sparkSession.dataSource.register(SealedLogs)
    dealt = lines.select(F.col(LOG).cast("string").alias(LOG), F.col("step").cast("int").alias("step"), TIME, POS, "line").repartition(LOG)
    dealt.sortWithinPartitions(LOG, "step", POS).drop(POS).write.format("chronolane_sealed").option("path", path).mode("append").save()
