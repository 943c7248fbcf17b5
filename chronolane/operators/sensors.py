"""Sensors: what reads frames, declared, checked and run over a table of frames.

A sensor says what it wants of a frame (``plan``) and reads many wants at once
(``read``), so a model sees batches whatever the number of wants in a frame. A
sensor that comes ``after`` others sees what those read in the same frame. The result
is the readings on offer that ``streaming.whole_pass`` takes its observations from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.model import LOG, TIME
from chronolane.streaming.whole_pass import Reader


@dataclass(frozen=True)
class Spec:
    """What a sensor declares: its signal, rates in frames a second, what it comes after, and what wakes it."""

    signal: str
    rate: float = 1.0
    thrift_rate: float = 1.0
    greedy: bool = False
    after: tuple[str, ...] = ()
    wake: str | None = None

    def __post_init__(self) -> None:
        if not 0 < self.thrift_rate <= self.rate:
            raise ValueError(f"{self.signal}: rates must be positive, the thrifty one no greater")


class Want(NamedTuple):
    """One reading that a sensor wants: its key, and what to read."""

    key: str
    part: object


class Reading(NamedTuple):
    value: str | None
    score: float


class Sensor(Protocol):
    spec: Spec

    def plan(self, frame: bytes, seen: dict[tuple[str, str], Reading]) -> list[Want]:
        """What to read of a frame; ``seen``: what lower levels read in it, by signal and key."""
        ...

    def read(self, parts: list) -> list[Reading | None]:
        """One reading for each part, by position; None gives no opinion."""
        ...


class Registry:
    """Sensors by signal, checked: every signal once, every dependency known, no cycle, all of ``required`` there."""

    def __init__(self, *sensors: Sensor, required: tuple[str, ...] = ()) -> None:
        self.sensors = {s.spec.signal: s for s in sensors}
        if len(self.sensors) < len(sensors):
            raise ValueError("a signal with two sensors")
        for name, s in self.sensors.items():
            missing = [m for m in ("plan", "read") if not callable(getattr(s, m, None))]
            unknown = [a for a in s.spec.after if a not in self.sensors]
            if missing or unknown:
                raise ValueError(f"{name}: no {', '.join(missing)}" if missing else f"{name} comes after unknown {', '.join(unknown)}")
        if lacking := sorted(set(required) - set(self.sensors)):
            raise ValueError(f"required sensors missing: {', '.join(lacking)}")
        order = TopologicalSorter({n: s.spec.after for n, s in self.sensors.items()})
        try:
            order.prepare()
        except CycleError as e:
            raise ValueError(f"a cycle: {' after '.join(e.args[1])}") from None
        self.levels: list[list[str]] = []
        while order.is_active():
            ready = order.get_ready()
            self.levels.append(sorted(ready))
            order.done(*ready)

    def closure(self, signals: set[str]) -> set[str]:
        """The signals and all that they come after."""
        out, rest = set(), set(signals)
        while rest:
            name = rest.pop()
            out.add(name)
            rest |= set(self.sensors[name].spec.after) - out
        return out

    def readers(self, layout: str, thrifty: bool = False) -> tuple[Reader, ...]:
        """How a session reads the sensors but the layout's."""
        level = {n: i for i, names in enumerate(self.levels) for n in names}
        specs = [s.spec for n, s in self.sensors.items() if n != layout]
        rate = lambda s: s.thrift_rate if thrifty else s.rate
        return tuple(Reader(s.signal, max(1, level[s.signal]), None if s.greedy else round(1_000_000 / rate(s)), s.wake) for s in specs)


def offered(frames: DataFrame, registry: Registry) -> DataFrame:
    """(log_id, t_us, frame, signal, key, v, score) of ``frames`` (log_id, t_us, frame, content): all that the sensors read, level by level.

    Frames are independent here, so they need no order and no shuffle; a batch of
    frames is read at once by each sensor.
    """
    kind = frames.schema[LOG].dataType.simpleString()
    names = [LOG, TIME, "frame", "signal", "key", "v", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(3).to_pylist()
            seen: list[dict[tuple[str, str], Reading]] = [{} for _ in contents]
            rows = []
            for level in registry.levels:
                fresh = []
                for name in level:
                    sensor = registry.sensors[name]
                    wants = [(i, w) for i, c in enumerate(contents) for w in sensor.plan(c, seen[i])]
                    found = sensor.read([w.part for _, w in wants])
                    fresh += [(i, name, w.key, r) for (i, w), r in zip(wants, found, strict=True) if r is not None]
                for i, name, key, r in fresh:  # a level's sensors don't see each other
                    seen[i][name, key] = r
                    rows.append((i, name, key, r.value, r.score))
            at = pa.array([r[0] for r in rows], pa.int64())
            own = [batch.column(c).take(at) for c in range(3)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([*own, *[pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(kinds)]], names=names)

    chosen = frames.select(LOG, F.col(TIME).cast("long").alias(TIME), F.col("frame").cast("long").alias("frame"), "content")
    return chosen.mapInArrow(run, f"{LOG} {kind}, {TIME} long, frame long, signal string, key string, v string, score double")
