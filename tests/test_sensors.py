"""A toy sensor pair over binary frames, into a session; and what a registry refuses."""

import pytest
from pyspark.sql import functions as F

from chronolane.operators.sensors import Reading, Registry, Spec, Want, offered
from chronolane.streaming.whole_pass import Rules, session


class Layout:
    spec = Spec("layout", greedy=True)

    def plan(self, frame, seen):
        return [Want("", frame)]

    def read(self, parts):
        return [Reading("on", 1.0) if p else Reading(None, 0.0) for p in parts]


class Digits:
    """Reads each byte of a frame that has a layout; zeros give no opinion."""

    spec = Spec("digit", rate=0.5, thrift_rate=0.25, after=("layout",))
    largest = 0

    def plan(self, frame, seen):
        return [Want(str(i), b) for i, b in enumerate(frame)] if seen["layout", ""].value else []

    def read(self, parts):
        return [Reading(str(b), b / 10) if b else None for b in parts]


def test_sensors_read_frames_and_a_session_takes_what_is_due(spark):
    frames = [("a", t * 1_000_000, t, bytes([t, 0, 7][: t % 4])) for t in range(8)]
    registry = Registry(Layout(), Digits(), required=("layout",))
    assert registry.levels == [["layout"], ["digit"]] and registry.closure({"digit"}) == {"digit", "layout"}
    df = offered(spark.createDataFrame(frames, "log_id string, t_us long, frame long, content binary").repartition(3), registry)
    got = sorted((r["t_us"] // 1_000_000, r["signal"], r["key"], r["v"]) for r in df.collect())
    want = [(t, "layout", "", "on" if c else None) for _, _, t, c in frames] + [(t, "digit", str(i), str(b)) for _, _, t, c in frames for i, b in enumerate(c) if b]
    assert got == sorted(want, key=lambda r: r[:3])
    rows = df.withColumns({"kind": F.when((F.col("signal") == "layout") & F.col("v").isNotNull(), "complete"), "marks": F.lit("{}")})
    taken = session(rows, Rules(registry.readers("layout"), 5_000_000, 10_000_000)).where("signal = 'digit'").collect()
    assert sorted({r["t_us"] // 1_000_000 for r in taken}) == [2, 6] and {r["why"] for r in taken} == {"clock"}
    assert registry.readers("layout", thrifty=True)[0].interval_us == 4_000_000


def test_registries_are_checked():
    class Wrong:
        spec = Spec("wrong", after=("nothing",))
        plan = read = lambda self, *a: []

    class Bare:
        spec = Spec("bare")

    class Turn(Digits):
        spec = Spec("digit", after=("back",))

    class Back(Digits):
        spec = Spec("back", after=("digit",))

    for make, what in ((lambda: Registry(Wrong()), "unknown nothing"), (lambda: Registry(Bare()), "no plan, read"), (lambda: Registry(Turn(), Back()), "a cycle"), (lambda: Registry(Layout(), Layout()), "two sensors"), (lambda: Registry(required=("layout",)), "missing: layout"), (lambda: Spec("x", 1.0, 2.0), "rates")):
        with pytest.raises(ValueError, match=what):
            make()
