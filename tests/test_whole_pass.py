"""The stateful pass: a loop's rows, in batches and in streams of any batch size; silent logs are told by timers."""

import json
import random

import pytest

from chronolane.streaming import whole_pass
from chronolane.streaming.whole_pass import Reader, Rules

S = 1_000_000
SCHEMA = "log_id string, t_us long, signal string, key string, v string, score double, kind string, marks string"
RULES = Rules((Reader("status", 1), Reader("pedals", 2, 3 * S), Reader("popups", 1, 8 * S, "changed"), Reader("banner", 1, 20 * S, "appeared")), 5 * S, 10 * S)


def offered(seed, logs=3, n=60):
    rnd = random.Random(seed)
    rows = []
    for log in range(logs):
        t, kind = 0, "complete"
        for _ in range(n):
            t += rnd.choice([1, 1, 1, 2, 3]) * S
            kind = rnd.choice([kind, kind, kind, "complete", "incomplete", None])
            marks = {"popups": rnd.choice(["[0]", "[1]"]), "banner": rnd.choice([None, None, "x"])}
            rows.append((f"log{log}", t, "layout", "", kind and "geometry", 1.0, kind, kind and json.dumps(marks)))
            for signal in ("status", "pedals", "popups", "banner"):
                for key in rnd.sample("ab", rnd.randint(0, 2)):
                    rows.append((f"log{log}", t, signal, key, rnd.choice([None, "1", "2"]), 0.5, None, None))
    return rows


def loop(rows, rules):
    """The pass as it reads in the description, frame by frame with one plain state."""
    out = []
    for log in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == log]
        held, clock, region, gone, partial, last = {}, {}, False, None, None, None
        for n, t in enumerate(sorted({r[1] for r in own})):
            frame = [r for r in own if r[1] == t]
            geo = next(r for r in frame if r[2] == "layout")
            lost = False
            if geo[6] is not None:
                gone = None
                if geo[6] == "complete":
                    region, partial = True, None
                elif not region:
                    partial = None
                elif partial is None:
                    partial = t
                elif t - partial >= rules.recheck_us:
                    region, partial = False, None
            elif gone is None:
                gone, partial = t, None
            elif region and t - gone >= rules.loss_us:
                region, lost = False, True
            marks = json.loads(geo[7]) if geo[7] else None
            new = [(0, "layout", "", geo[4], 1.0, "layout")]
            for reader in rules.readers:
                why = None
                if reader.interval_us is None:
                    why = "greedy"
                elif reader.signal not in clock or t - clock[reader.signal] >= reader.interval_us:
                    clock[reader.signal], why = t, "clock"
                elif reader.wake == "changed":
                    why = "wake" if n and marks and last and marks[reader.signal] != last[reader.signal] else None
                elif reader.wake == "appeared":
                    why = "wake" if marks and marks[reader.signal] and not (last and last[reader.signal]) else None
                new += [(reader.level, *r[2:6], why) for r in sorted(frame, key=lambda r: r[2:4]) if r[2] == reader.signal and why]
            if lost:
                new += [(next(r.level for r in rules.readers if r.signal == s), s, k, None, 0.0, "lost") for s, k in held if s != "layout"]
            for level, signal, key, v, score, why in sorted(new, key=lambda x: x[:3]):
                out.append((log, t, signal, key, v, score, why))
                held.pop((signal, key), None)
                if v is not None:
                    held[signal, key] = v
            last = marks
    return out


def rows_of(df):
    return [tuple(None if x is None or x != x else x for x in r) for r in df.collect()]


def in_order(rows, log):
    return [r for r in rows if r[0] == log]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_equals_a_loop(spark, seed):
    rows = offered(seed)
    got = rows_of(whole_pass.session(spark.createDataFrame(rows, SCHEMA).repartition(4), RULES))
    want = loop(rows, RULES)
    assert {"lost", "wake", "clock"} <= {r[6] for r in want}
    for log in {r[0] for r in rows}:
        assert in_order(got, log) == in_order(want, log)


def streamed(spark, tmp_path, batches, rules, name, late):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = whole_pass.session_stream(source, rules, late)
    run = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    return [tuple(None if x is None or x != x else x for x in r) for r in spark.table(name).collect()]


@pytest.mark.parametrize("size", [40, 10_000])
def test_stream_equals_batch_for_any_batch_size_and_order_within_the_delay(spark, tmp_path, size):
    rows = offered(5, logs=2, n=40)
    rnd = random.Random(1)
    # Rows come up to 20 seconds out of order, and frames are cut by batches.
    rows.sort(key=lambda r: r[1] + rnd.randrange(20 * S))
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    end = max(r[1] for r in rows) + 1000 * S
    batches.append([("other", end, "layout", "", "g", 1.0, "complete", "{}")])  # moves the watermark past all frames
    got = streamed(spark, tmp_path, batches, RULES, f"pass_{size}", "30 seconds")
    want = rows_of(whole_pass.session(spark.createDataFrame(rows, SCHEMA), RULES))
    for log in {r[0] for r in rows}:
        assert in_order(got, log) == in_order(want, log)
    assert in_order(got, "other") == []  # its frame waits for the watermark


def test_a_log_that_falls_silent_is_lost_after_its_limit(spark, tmp_path):
    rules = Rules(RULES.readers, 5 * S, 10 * S, silent_us=30 * S)
    quiet = [("quiet", 10 * S, "layout", "", "g", 1.0, "complete", "{}"), ("quiet", 10 * S, "status", "a", "1", 0.5, None, None), ("quiet", 10 * S, "pedals", "b", "2", 0.5, None, None)]
    going = [("going", t * S, "layout", "", "g", 1.0, "complete", "{}") for t in range(0, 60, 5)]
    batches = [quiet + going[:3], going[3:8], going[8:]]
    got = streamed(spark, tmp_path, batches, rules, "silent", "2 seconds")
    told = [r for r in got if r[6] == "silent"]
    assert told == [("quiet", 40 * S, "status", "a", None, 0.0, "silent"), ("quiet", 40 * S, "pedals", "b", None, 0.0, "silent")]
    batch = rows_of(whole_pass.session(spark.createDataFrame(quiet + going, SCHEMA), rules, until_us=53 * S))
    assert sorted(batch, key=repr) == sorted(got, key=repr)


def test_readers_are_checked():
    for wrong in (lambda: Reader("x", 0), lambda: Reader("x", 1, 0), lambda: Reader("x", 1, None, "often"), lambda: Rules((Reader("x", 1), Reader("x", 2)), 1, 1), lambda: Rules((Reader("layout", 1),), 1, 1)):
        with pytest.raises(ValueError):
            wrong()
