"""Stateful session logic, the same code for batches and for streams.

Greedy cadence: a reading is due if it is the first of its key or comes at least
one interval after the last due one. Gate loss: once the gate has been absent for
a limit, every held key gets one confirmed absence. Both need rows in time order;
a micro-batch is sorted, and rows older than the state's last time are late and
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.model import LOG, POS, TIME


def due(times: list[int], last: int | None, interval_us: int) -> tuple[list[bool], int | None]:
    out = []
    for t in times:
        hit = last is None or t - last >= interval_us
        out.append(hit)
        last = t if hit else last
    return out, last


def greedy_cadence(rows: DataFrame, interval_us: int, by: str = LOG) -> DataFrame:
    """The due rows of a batch. Rows stream through tasks sorted by key and time, so memory does not grow with a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in batches:
            keep = []
            for k, t in zip(pdf[by].tolist(), pdf[TIME].tolist()):
                if k != key:
                    key, last = k, None
                hit, last = due([t], last, interval_us)
                keep += hit
            yield pdf[keep]

    return rows.repartition(by).sortWithinPartitions(by, TIME, POS).mapInPandas(run, rows.schema)


def greedy_cadence_stream(rows: DataFrame, interval_us: int, by: str = LOG) -> DataFrame:
    """The due rows of a stream of (by, t_us, pos); the state is one time for each key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, newest = state.get if state.exists else (None, None)
        pdf = pd.concat(list(parts)).sort_values([TIME, POS])
        if newest is not None:
            pdf = pdf[pdf[TIME] >= newest]
        keep, last = due(pdf[TIME].tolist(), last, interval_us)
        if len(pdf):
            state.update((last, int(pdf[TIME].max())))
        yield pdf[keep][[by, TIME, POS]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"{by} {kinds[by]}, {TIME} long, {POS} long"
    return rows.select(by, TIME, POS).groupBy(by).applyInPandasWithState(run, schema, "last long, newest long", "append", GroupStateTimeout.NoTimeout)


def gate_loss_tombstones(obs: DataFrame, gate: str, limit_us: int, keys: list[str]) -> DataFrame:
    """(log_id, keys, t_us, since_us): one absence for every key held when the gate has been absent for ``limit_us``.

    The gate's rows with a null v are its absences. Only a gate that was present
    before can be lost, and each loss counts once, at the first gate row at or
    past the limit.
    """
    from pyspark.sql import Window

    from chronolane.operators.runs import islands

    rows = islands(obs.where(F.col("signal") == gate), [LOG], F.col("v").isNull().cast("int"))
    start = F.min(TIME).over(Window.partitionBy(LOG, "grp"))
    lost = (
        rows.withColumn("since_us", start)
        .where((F.col("kind") == 1) & (F.col("grp") > 1) & (F.col(TIME) - F.col("since_us") >= limit_us))
        .groupBy(LOG, "grp", "since_us")
        .agg(F.min(TIME).alias("lost_us"))
        .select(LOG, "since_us", "lost_us")
    )
    others = obs.where(F.col("signal") != gate)
    w = Window.partitionBy(LOG, "signal", *keys).orderBy(TIME, POS)
    held = others.withColumn("until_us", F.lead(TIME).over(w)).where("v is not null")
    # Losses are few for a log, and each row of a key holds for one span of time.
    return (
        held.join(lost, LOG)
        .where((F.col(TIME) <= F.col("lost_us")) & (F.col("until_us").isNull() | (F.col("until_us") > F.col("lost_us"))))
        .select(LOG, "signal", *keys, F.col("lost_us").alias(TIME), "since_us")
    )


def windowed(rows: DataFrame, size: str, late: str, by: list[str]) -> DataFrame:
    """Counts in tumbling windows of event time (column ts), late rows up to ``late`` included."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", size), *by).agg(F.count(F.lit(1)).alias("n"))


def gate_step(time: int, kind: str | None, state: tuple, loss_us: int, recheck_us: int) -> tuple[str | None, tuple]:
    """What a gate reading brings, ``lost``, ``recheck`` or None, and the state after it.

    ``kind``: None (absent), ``incomplete`` or ``complete``. State: whether a
    complete reading is remembered, since when the gate is absent, since when it is
    incomplete. Absence or incompleteness for its limit, while a complete reading is
    remembered, forgets that reading.
    """
    known, gone, partial = state
    if kind == "complete":
        return None, (True, None, None)
    if kind == "incomplete":
        if not known:
            return None, (False, None, None)
        if partial is None:
            return None, (True, None, time)
        return ("recheck", (False, None, None)) if time - partial >= recheck_us else (None, (True, None, partial))
    if gone is None:
        return None, (known, time, None)
    return ("lost", (False, gone, partial)) if known and time - gone >= loss_us else (None, (known, gone, partial))


def gate_events(readings: DataFrame, loss_us: int, recheck_us: int) -> DataFrame:
    """(log_id, t_us, pos, event) of a batch of gate readings (log_id, t_us, pos, kind), streamed through tasks sorted by log and time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, state = None, (False, None, None)
        for pdf in batches:
            out = []
            for own, t, pos, kind in pdf.itertuples(index=False):
                if own != log:
                    log, state = own, (False, None, None)
                event, state = gate_step(t, kind, state, loss_us, recheck_us)
                if event:
                    out.append((own, t, pos, event))
            yield pd.DataFrame(out, columns=[LOG, TIME, POS, "event"])

    kind = readings.schema[LOG].dataType.simpleString()
    rows = readings.select(LOG, TIME, POS, "kind").repartition(LOG).sortWithinPartitions(LOG, TIME, POS)
    return rows.mapInPandas(run, f"{LOG} {kind}, {TIME} long, {POS} long, event string")


def gate_events_stream(readings: DataFrame, loss_us: int, recheck_us: int) -> DataFrame:
    """The same of a stream; the state is four numbers for each log, rows older than its last are left out."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, gone, partial, newest = state.get if state.exists else (False, None, None, None)
        out, own = [], (bool(known), gone, partial)
        for t, pos, kind in pd.concat(list(parts)).sort_values([TIME, POS])[[TIME, POS, "kind"]].itertuples(index=False):
            if newest is not None and t < newest:
                continue
            event, own = gate_step(t, kind, own, loss_us, recheck_us)
            newest = t
            if event:
                out.append((key[0], t, pos, event))
        state.update((*own, newest))
        yield pd.DataFrame(out, columns=[LOG, TIME, POS, "event"])

    kind = readings.schema[LOG].dataType.simpleString()
    schema = f"{LOG} {kind}, {TIME} long, {POS} long, event string"
    rows = readings.select(LOG, TIME, POS, "kind").groupBy(LOG)
    return rows.applyInPandasWithState(run, schema, "known boolean, gone long, partial long, newest long", "append", GroupStateTimeout.NoTimeout)
