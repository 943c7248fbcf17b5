"""A session in one stateful pass: what of the readings on offer becomes an observation.

Input rows (log_id, t_us, signal, key, v, score, kind, marks) offer what each sensor
would read at a frame. The layout is read in every frame and is the clock: its
``kind`` is ``complete``, ``incomplete`` or null (absent), its ``marks`` (JSON object)
say what can wake a sensor. Another signal is read if it is greedy, if its clock is
due, or if its mark wakes it; a wake leaves the clock alone. A long absence of the
layout, or of any row, clears every held key with one absence each. A frame's
observations come out by level, signal and key.

``session`` runs over a batch, ``session_stream`` over a stream: the same pass, whose
state is kept as values and maps of the state store. A stream holds rows back until
the watermark has passed them, so the result depends neither on the sizes of
micro-batches nor on the order of rows within the delay, and event-time timers let go
of the last frame and tell a log that fell silent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronolane.model import LOG, TIME

from .sessions import gate_step

READING = f"{TIME} long, signal string, key string, v string, score double, kind string, marks string"
COLUMNS = [c.split(" ")[0] for c in READING.split(", ")]
#: Added to event times in a stream: a first watermark of zero would call a log's row at zero late.
SHIFT_US = 86_400_000_000
OUT = f"{TIME} long, signal string, key string, v string, score double, why string"
NAMES = [c.split(" ")[0] for c in OUT.split(", ")]


@dataclass(frozen=True)
class Reader:
    """How a signal is read: every ``interval_us`` (None: in every frame), after the signals that ``level`` stands behind, woken by its mark if it ``changed`` or ``appeared``."""

    signal: str
    level: int
    interval_us: int | None = None
    wake: str | None = None

    def __post_init__(self) -> None:
        if self.level < 1 or self.wake not in (None, "changed", "appeared") or (self.interval_us is not None and self.interval_us <= 0):
            raise ValueError(f"not a reader: {self}")


@dataclass(frozen=True)
class Rules:
    readers: tuple[Reader, ...]
    loss_us: int
    recheck_us: int
    #: A log without any row for so long is lost; None: never.
    silent_us: int | None = None
    layout: str = "layout"

    def __post_init__(self) -> None:
        names = [r.signal for r in self.readers]
        if len({*names, self.layout}) <= len(names):
            raise ValueError(f"a signal with two readers: {names}")


class Pass:
    """One log's state, and the step that a frame is."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.level = {rules.layout: 0} | {r.signal: r.level for r in rules.readers}
        self.gate: tuple = (False, None, None)
        self.newest: int | None = None
        self.marks: dict | None = None
        self.clocks: dict[str, int] = {}
        self.held: dict[tuple[str, str], str] = {}

    def _due(self, t: int, marks: dict | None, first: bool) -> dict[str, str]:
        out = {}
        for r in self.rules.readers:
            now, before = (marks or {}).get(r.signal), (self.marks or {}).get(r.signal)
            last = self.clocks.get(r.signal)
            if r.interval_us is None:
                out[r.signal] = "greedy"
            elif last is None or t - last >= r.interval_us:
                self.clocks[r.signal], out[r.signal] = t, "clock"
            elif r.wake == "changed" and not first and marks is not None and self.marks is not None and now != before:
                out[r.signal] = "wake"
            elif r.wake == "appeared" and now is not None and before is None:
                out[r.signal] = "wake"
        return out

    def _absences(self, why: str) -> list[tuple]:
        return [(signal, key, None, 0.0, why) for signal, key in self.held if signal != self.rules.layout]

    def _emitted(self, t: int, rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda r: (self.level[r[0]], r[0], r[1]))
        for signal, key, v, *_ in rows:
            if v is None:
                self.held.pop((signal, key), None)
            else:
                self.held[signal, key] = v
        return [(t, *r) for r in rows]

    def silence(self, until: int) -> list[tuple]:
        """The absences of a log that has had no row for the limit by ``until``."""
        limit = self.rules.silent_us
        if limit is None or self.newest is None or not self.gate[0] or self.newest + limit > until:
            return []
        self.gate, self.marks = (False, self.newest, None), None
        return self._emitted(self.newest + limit, self._absences("silent"))

    def frame(self, t: int, rows: list[tuple]) -> list[tuple]:
        """The observations of one frame, from its rows (signal, key, v, score, kind, marks)."""
        before = self.silence(t)
        layout = next((r for r in rows if r[0] == self.rules.layout), (self.rules.layout, "", None, 0.0, None, None))
        marks = None if layout[4] is None else json.loads(layout[5] or "{}")
        event, self.gate = gate_step(t, layout[4], self.gate, self.rules.loss_us, self.rules.recheck_us)
        due = self._due(t, marks, self.newest is None)
        out = [(layout[0], layout[1], None if layout[4] is None else layout[2], layout[3], "layout")]
        out += [(s, k, v, c, due[s]) for s, k, v, c, *_ in rows if s in due]
        if event == "lost":
            out += self._absences("lost")
        self.newest, self.marks = t, marks
        return before + self._emitted(t, out)


def _plain(x):
    """Spark's nulls as pandas has them, as None."""
    return None if x is None or x != x else x


def _frames(rows: list[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (t_us, signal, ...) in order, as frames."""
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or ""))
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][0] == rows[at][0]:
            end += 1
        yield rows[at][0], [r[1:] for r in rows[at:end]]
        at = end


def _offered(readings: DataFrame) -> DataFrame:
    return readings.select(LOG, TIME, "signal", F.coalesce("key", F.lit("")).alias("key"), "v", F.coalesce("score", F.lit(0.0)).alias("score"), "kind", "marks")


def session(readings: DataFrame, rules: Rules, until_us: int | None = None) -> DataFrame:
    """(log_id, t_us, signal, key, v, score, why) of a batch; ``until_us``: only frames before it, and silence up to it.

    Logs stream through sorted partitions; a frame is what is in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, state, t, open_rows = None, None, None, []

        def closed() -> list[tuple]:
            return [(log, *r) for now, rows in _frames(open_rows) for r in state.frame(now, rows)] if open_rows else []

        def left() -> list[tuple]:
            return [] if until_us is None or state is None else [(log, *r) for r in state.silence(until_us)]

        for pdf in batches:
            out = []
            for own, *row in pdf.itertuples(index=False):
                row = tuple(map(_plain, row))
                if own != log or row[0] != t:
                    out += closed()
                    open_rows = []
                    if own != log:
                        out += left()
                        log, state = own, Pass(rules)
                    t = row[0]
                open_rows.append(row)
            yield pd.DataFrame(out, columns=[LOG, *NAMES])
        yield pd.DataFrame(closed() + left(), columns=[LOG, *NAMES])

    kind = readings.schema[LOG].dataType.simpleString()
    rows = _offered(readings) if until_us is None else _offered(readings).where(F.col(TIME) < until_us)
    return rows.repartition(LOG).sortWithinPartitions(LOG, TIME).mapInPandas(run, f"{LOG} {kind}, {OUT}")


class Processor(StatefulProcessor):
    """``Pass`` on the state store, one log a key."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.one = handle.getValueState("pass", "known boolean, gone long, partial long, newest long, marks string")
        self.clocks = handle.getMapState("clocks", "signal string", "t long")
        self.held = handle.getMapState("held", "signal string, key string", "v string")
        self.waiting = handle.getListState("waiting", READING)

    def _load(self) -> Pass:
        out = Pass(self.rules)
        if self.one.exists():
            known, gone, partial, newest, marks = self.one.get()
            out.gate, out.newest, out.marks = (bool(known), gone, partial), newest, None if marks is None else json.loads(marks)
            out.clocks = {k[0]: v[0] for k, v in self.clocks.iterator()}
            out.held = {tuple(k): v[0] for k, v in self.held.iterator()}
        return out

    def _save(self, now: Pass, clocks: dict, held: dict) -> None:
        """Only what the pass has changed."""
        self.one.update((*now.gate, now.newest, None if now.marks is None else json.dumps(now.marks)))
        for signal, t in now.clocks.items():
            if clocks.get(signal) != t:
                self.clocks.updateValue((signal,), (t,))
        for entry in held.keys() - now.held.keys():
            self.held.removeKey(entry)
        for entry, v in now.held.items():
            if held.get(entry) != v:
                self.held.updateValue(entry, (v,))

    def _advanced(self, key: tuple, rows: list[tuple], watermark_us: int) -> Iterator[pd.DataFrame]:
        now = self._load()
        clocks, held, newest = dict(now.clocks), dict(now.held), now.newest
        gate = now.gate
        rows = [r for r in rows if newest is None or r[0] > newest]
        ready = [r for r in rows if r[0] < watermark_us]
        wait = [r for r in rows if r[0] >= watermark_us]
        out = [o for t, own in _frames(ready) for o in now.frame(t, own)]
        out += now.silence(watermark_us)
        if ready or now.gate != gate:
            self._save(now, clocks, held)
        if wait:
            self.waiting.put(wait)
            self.handle.registerTimer((min(r[0] for r in wait) + SHIFT_US) // 1000 + 1)
        else:
            self.waiting.clear()
        if self.rules.silent_us is not None and now.gate[0] and now.newest is not None:
            self.handle.registerTimer(-(-(now.newest + self.rules.silent_us + SHIFT_US) // 1000))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=[LOG, *NAMES])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [tuple(map(_plain, r)) for pdf in rows for r in pdf[COLUMNS].itertuples(index=False)]
        yield from self._advanced(key, [*map(tuple, self.waiting.get()), *fresh], timerValues.getCurrentWatermarkInMs() * 1000 - SHIFT_US)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advanced(key, [*map(tuple, self.waiting.get())], timerValues.getCurrentWatermarkInMs() * 1000 - SHIFT_US)


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_stream(readings: DataFrame, rules: Rules, late: str = "10 seconds") -> DataFrame:
    """The same of a stream; rows up to ``late`` behind the newest count, later ones are left out.

    The session needs the RocksDB state store, which is set here.
    """
    spark = readings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = _offered(readings).withColumn("ts", F.timestamp_micros(F.col(TIME) + SHIFT_US)).withWatermark("ts", late)
    kind = readings.schema[LOG].dataType.simpleString()
    return timed.groupBy(LOG).transformWithStateInPandas(Processor(rules), f"{LOG} {kind}, {OUT}", "append", "eventTime")
