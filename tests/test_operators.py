"""Operators against loops written from their definitions, on seeded random sequences, and at their boundaries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chronolane.functions import fuzzy, text
from chronolane.operators import archive, intervals, patches, privacy, rules, runs, temporal, wire
from chronolane.operators.patches import apply_patches
from chronolane.sources import jsonl, tails
from chronolane.streaming import live, sessions

OBS = "log_id int, col int, t_us long, pos long, frame long, signal string, v long, score long"


def _obs(spark, rows):
    return spark.createDataFrame([(0, 1, t, i, i, "s", v, 0) for i, (t, v) in enumerate(rows)], OBS)


def _spans(df):
    return sorted((r["start_us"], r["end_us"], r["value"]) for r in df.collect())


def _runs_by_loop(times, snaps):
    out, held, spacing, before = [], {}, 0, None
    for t, snap in zip(times, snaps):
        spacing = t - before if before is not None else 0
        for lane in [x for x in held if x not in snap]:
            out.append((lane, held[lane][0], t, held.pop(lane)[1]))
        for lane, v in snap.items():
            if lane not in held:
                held[lane] = [t, v]
            elif v is not None and held[lane][1] is None:
                held[lane][1] = v
            elif v is not None and v != held[lane][1]:
                out.append((lane, held[lane][0], t, held[lane][1]))
                held[lane] = [t, v]
        before = t
    return sorted(out + [(lane, s, before + spacing, v) for lane, (s, v) in held.items()], key=repr)


def test_runs_equal_a_loop(spark):
    rnd = random.Random(5)
    frames, shown, want = [], [], []
    for log in range(60):
        times = sorted(rnd.sample(range(100), rnd.randint(1, 8)))
        snaps = [{lane: rnd.choice([None, 1, 2]) for lane in range(3) if rnd.random() < 0.6} for _ in times]
        frames += [(log, i + 1, t) for i, t in enumerate(times)]
        shown += [(log, i + 1, lane, v) for i, s in enumerate(snaps) for lane, v in s.items()]
        want += [(log, *r) for r in _runs_by_loop(times, snaps)]
    got = runs.encode_runs(
        spark.createDataFrame(frames, "log_id int, fo int, t_us long"), spark.createDataFrame(shown, "log_id int, fo int, col int, v long"), ["col"]
    )
    assert sorted(((r.log_id, r.col, r.start_us, r.end_us, r.v) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_change_points_give_the_runs_of_all_frames(spark, sf_dir):
    from chronolane.operators import lanes

    rnd = random.Random(11)
    rows = []
    for log in range(12):
        t = 0
        for i in range(60):
            t += rnd.choice([0, 1, 5])
            signal = rnd.choice(["view", "click", "error", "purchase", "signup"])
            rows.append((log, rnd.randint(1, 2), t, i, t, signal, rnd.choice([None, None, 0, 1, 2]), 0))
    obs = spark.createDataFrame(rows, "log_id long, col long, t_us long, pos long, frame long, signal string, v long, score long")
    obs = obs.withColumn("v", F.when(F.col("signal") == "view", F.when(F.col("v") == 1, 1)).otherwise(F.col("v")))
    grid = temporal.frames(obs)
    painted = lanes.unpivot(grid, temporal.carry_forward(obs, ["signal", "col"]), "view", lanes.PROJECTORS)
    cols = ["log_id", "lane", "col", "start_us", "end_us", "v"]
    dense = runs.encode_runs(grid, painted, ["lane", "col"]).select(*cols)
    ends = lanes.closes(obs)
    sparse = runs.encode_changes(lanes.lane_changes(obs, "view", lanes.PROJECTORS, ends), ends.select("log_id", "close_us"), ["lane", "col"]).select(*cols)
    assert sorted(map(repr, sparse.collect())) == sorted(map(repr, dense.collect()))


def test_patches_equal_applying_them_in_order(spark):
    rnd = random.Random(6)
    rows = [(t, rnd.randint(0, 3)) for t in range(30)]
    laid = []
    for i in range(40):
        a = rnd.randint(0, 29)
        b = a + rnd.choice([0, 0, 3, 8])
        act = "delete" if rnd.random() < 0.15 else "set"
        laid.append((0, 1, a, b, act, None if act == "delete" else rnd.choice([None, 7, 8, 9]), i))
    want = []
    for t, v in rows:
        for _, _, a, b, act, new, _ in laid:
            if (t == a) if a == b else (a <= t < b):
                if act == "delete":
                    break
                v = new
        else:
            want.append((t, v))
    df = spark.createDataFrame(laid, "log_id int, col int, start_us long, end_us long, action string, value long, patch_idx long")
    got = patches.apply_patches(_obs(spark, rows), patches.validated(df), ["col"], bucket_us=4)
    assert sorted(((r.t_us, r.v) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_a_delete_with_a_value_is_an_error(spark):
    bad = spark.createDataFrame([(0, 1, 0, 1, "delete", 5, 0)], "log_id int, col int, start_us long, end_us long, action string, value long, patch_idx long")
    with pytest.raises(Exception, match="bad patch"):
        patches.validated(bad).collect()


def test_debounce_is_strict_and_the_last_run_borrows(spark):
    rule = rules.Debounce("s", 20, 0)
    assert _spans(rule.patches(_obs(spark, [(100, 0), (110, 1), (125, 0)]), ["col"])) == [(110, 125, 0)]
    assert _spans(rule.patches(_obs(spark, [(100, 0), (110, 1), (130, 0)]), ["col"])) == []
    assert _spans(rule.patches(_obs(spark, [(1, 0), (11, 0), (21, 1)]), ["col"])) == [(21, 31, 0)]
    assert _spans(rule.patches(_obs(spark, [(5, 1)]), ["col"])) == [(5, 5, 0)]


def test_fill_gap_needs_equal_neighbours_and_is_inclusive(spark):
    rule = rules.FillGap("s", 10)
    assert _spans(rule.patches(_obs(spark, [(0, 4), (5, None), (15, 4)]), ["col"])) == [(5, 15, 4)]
    assert _spans(rule.patches(_obs(spark, [(0, 4), (5, None), (16, 4)]), ["col"])) == []
    assert _spans(rule.patches(_obs(spark, [(0, 4), (5, None), (9, 3)]), ["col"])) == []
    assert _spans(rule.patches(_obs(spark, [(0, None), (5, 4), (9, None)]), ["col"])) == []


def test_bracketed_gap(spark):
    rule = rules.BracketedGap("s", 10, 2)
    assert _spans(rule.patches(_obs(spark, [(0, 2), (1, 1), (5, 2)]), ["col"])) == []
    assert _spans(rule.patches(_obs(spark, [(0, 2), (1, 1), (20, 2)]), ["col"])) == [(1, 20, None)]
    assert _spans(rule.patches(_obs(spark, [(0, None), (1, 1), (5, 2)]), ["col"])) == [(1, 5, None)]


def test_rules_round_trip_and_reject(spark):
    own = [rules.Debounce("a", 5, 0), rules.FillGap("b", 7), rules.UniqueByScore("c")]
    assert rules.from_settings([rules.settings(r) for r in own]) == own
    with pytest.raises(ValueError, match="debounce"):
        rules.from_settings([{"name": "nope:a"}])
    with pytest.raises(TypeError):
        rules.from_settings([{"name": "debounce:a", "signal": "a", "min_us": "x"}])


def test_asof_distinguishes_no_row_from_a_null_row(spark):
    left = spark.createDataFrame([(0, 5, 0), (0, 15, 1), (0, 25, 2)], "log_id int, t_us long, pos long")
    right = spark.createDataFrame([(0, 10, 0, 7), (0, 25, 1, None)], "log_id int, t_us long, pos long, v int")
    got = {r.t_us: r.got for r in temporal.asof(left, right, ["log_id"], ["v"]).collect()}
    assert got[5] is None and got[15].v == 7 and got[25] is not None and got[25].v is None
    strict = {r.t_us: r.got for r in temporal.asof(left, right, ["log_id"], ["v"], inclusive=False).collect()}
    assert strict[25].v == 7


def test_first_per_tick_equals_the_sequential_rule(spark):
    rnd = random.Random(7)
    times = sorted(rnd.sample(range(0, 10_000_000), 200))
    want, due = [], None
    for t in times:
        tick = int((t - times[0]) / 1e6 * 3 + 1e-6)
        if due is None or tick >= due:
            want.append(t)
            due = tick + 1
    got = temporal.first_per_tick(_obs(spark, [(t, 1) for t in times]), ["log_id"], 3)
    assert sorted(r.t_us for r in got.collect()) == want


def test_touching_runs_stay_apart(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 5, 9), (0, 8, 12)], "log_id int, start_us long, end_us long")
    assert sorted((r.start_us, r.end_us) for r in intervals.merge_overlapping(df, ["log_id"]).collect()) == [(0, 5), (5, 12)]


def test_episode_snaps_outwards_and_borrows_spacing(spark):
    found = spark.createDataFrame([(0, 10, 20), (0, 40, 40)], "log_id int, first_us long, last_us long")
    grid = spark.createDataFrame([(0, t, t) for t in (0, 10, 20, 30)], "log_id int, t_us long, pos long")
    got = sorted((r.start_us, r.end_us) for r in privacy.snapped(found, grid, ["log_id"]).collect())
    assert got == [(0, 30), (30, 50)]


def test_template_problems(spark):
    rows = [("a", "hello {x}: this is a tail"), ("b", "{y} this is a tail".replace(" this", ": this")), ("c", "no place"), ("d", "{x} abc"), ("e", "Upper {x} and long enough")]
    got = {r.template_id: r.problem for r in privacy.template_errors(spark.createDataFrame(rows, "template_id string, template string")).collect()}
    assert got == {"a": "repeated tail", "b": "repeated tail", "c": "no placeholder", "d": "short tail", "e": "not lower case"}


def test_query_tokens():
    assert archive.tokenize('name:foo bar') == [("name", "foo"), (None, "bar")]
    assert archive.tokenize('"two words" x') == [(None, "two words"), (None, "x")]
    assert archive.tokenize("nope:foo") == [(None, "nope:foo")]
    assert archive.tokenize('POPUP:"open end') == [("popup", "open end")]
    assert archive.tokenize("  ") == []


def test_ratios():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        return new

    rnd = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(2))
        assert fuzzy.common_subsequence(a, b) == lcs(a, b)
    assert fuzzy.ratio_of("", "") == 100 and fuzzy.partial_ratio_of("abc", "xxabcxx") == 100
    assert fuzzy.ratio_of("strono", "strong") > 80 > fuzzy.ratio_of("zzzz", "strong")


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße  Ä-\nb!",)], "x string")
    row = df.select(text.casefold(F.col("x")).alias("a"), text.normalized(F.col("x")).alias("b"), text.folded("x").alias("c"), text.titled(F.lit("a_bC d")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("strasse  ä-\nb!", "strasse ä b", "strasse ab", "A BC D")


def test_packed_log_tells_its_tail(spark, tmp_path):
    import gzip

    data = tails.packed(b"head", b"one\ntwo\n", b"appendix", b"footer")
    a, b = tails.tail_sizes(data[:64])
    assert gzip.decompress(data) == b"head\none\ntwo\nappendix\nfooter\n" and tails.head_line(data) == b"head"
    assert gzip.decompress(data[-b:]) == b"footer\n" and gzip.decompress(data[-a - b : -b]) == b"appendix\n"
    assert tails.tail_sizes(gzip.compress(b"x" * 99)) is None and tails.head_line(gzip.compress(b"x")) is None and tails.head_line(b"no gzip") is None
    bare = tails.packed(b"head", b"", None, b"footer")
    files = {"a.gz": data, "b.gz": gzip.compress(b"head\n\none\ntwo\n"), "c.jsonl": b"head\none\n\ntwo", "d.gz": bare, "e.jsonl": b"\n"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    want = {"a.gz": ("head", "appendix", "footer"), "b.gz": ("head", "one", "two"), "c.jsonl": ("head", "one", "two"), "d.gz": ("head", "", "footer"), "e.jsonl": ("", "", "")}
    for whole in (False, True):
        listed = tails.listing(spark, str(tmp_path))
        if whole:
            listed = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path as name", "length as size", "content")
        got = {r["name"].rsplit("/", 1)[1]: (r["first"], r["second_last"], r["last"]) for r in tails.edge_lines(listed, whole).collect()}
        assert got == want
    import hashlib

    assert {r["sha256"] for r in tails.sha256(spark, str(tmp_path)).collect()} == {hashlib.sha256(x).hexdigest() for x in files.values()}


def test_rules_of_every_kind_come_back_from_settings(spark):
    actions = spark.createDataFrame([("a", "blue", ["cut"])], "alias string, color string, labels array<string>")
    own = wire.default_rules(actions)
    kept = [rules.settings(r) for r in own]
    assert json.loads(json.dumps(kept)) == kept
    assert rules.from_settings(kept, actions=actions) == own


def test_patches_of_any_length_and_bad_ones(spark):
    day = 86_400_000_000
    obs = spark.createDataFrame([(1, i * day // 3, i, "a", i) for i in range(60)], "log_id int, t_us long, pos long, signal string, v long")
    spans = [(0, 0, 10 * day, "set", -1, 0), (0, 3 * day, 3 * day, "set", -2, 1), (0, 4 * day, 5 * day, "delete", None, 2), (0, 0, 19 * day, "set", -3, 3)]
    patches = spark.createDataFrame([(1, "a", s, e, act, v, i) for _, s, e, act, v, i in spans], "log_id int, signal string, start_us long, end_us long, action string, value long, patch_idx long")
    want = {}
    for i in range(60):
        t, v, gone = i * day // 3, i, False
        for _, s, e, act, new, _ in spans:
            if (t == s) if s == e else s <= t < e:
                gone, v = gone or act == "delete", new if act == "set" else v
        if not gone:
            want[i] = v
    assert {r["pos"]: r["v"] for r in apply_patches(obs, patches, ["signal"]).collect()} == want
    with pytest.raises(Exception, match="bad patch"):
        apply_patches(obs, patches.withColumn("action", F.lit("nope")), ["signal"]).collect()


def test_gate_events_of_streams_and_batches(spark, tmp_path):
    rnd = random.Random(4)
    rows, want = [], []
    for log in range(3):
        t, known, gone, partial = 0, False, None, None
        for i in range(150):
            t += rnd.randint(1, 4)
            kind = rnd.choices([None, "incomplete", "complete"], [5, 4, 1])[0]
            rows.append((log, t, i, kind))
            if kind == "complete":
                known, gone, partial = True, None, None
            elif kind == "incomplete":
                gone = None
                if not known:
                    partial = None
                elif partial is None:
                    partial = t
                elif t - partial >= 9:
                    known, partial = False, None
                    want.append((log, t, i, "recheck"))
            elif gone is None:
                gone, partial = t, None
            elif known and t - gone >= 6:
                known = False
                want.append((log, t, i, "lost"))
    schema = "log_id int, t_us long, pos long, kind string"
    batch = sessions.gate_events(spark.createDataFrame(rows, schema), 6, 9)
    assert sorted(tuple(r) for r in batch.collect()) == sorted(want) and {w[3] for w in want} == {"lost", "recheck"}
    rows.sort(key=lambda r: r[1])
    for i in range(0, len(rows), 150):
        spark.createDataFrame(rows[i : i + 150], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = sessions.gate_events_stream(source, 6, 9).writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(180)
    assert sorted(tuple(r) for r in spark.table("gate").collect()) == sorted(want)


def test_live_logs_are_read_while_open_and_sealed(spark, tmp_path):
    schema = "log_id string, pos long, t_us long, frame long, signal string, key array<string>, value string, score double"
    rows = [("a" if i % 2 else "b", i, i * 1000, i, "arm", ["2"], None if i % 3 else "x", 0.5) for i in range(20)]
    for n, part in enumerate((rows[:9], rows[9:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.append(source, str(tmp_path / "open"), str(tmp_path / "cp"), {"availableNow": True}).awaitTermination(120)
        assert live.read(spark, str(tmp_path / "open")).count() == (9, 20)[n]
    live.seal(spark, str(tmp_path / "open"), str(tmp_path / "done"))
    back = jsonl.observations(jsonl.read_lines(spark, str(tmp_path / "done")))
    assert sorted(r["t_us"] for r in back.collect()) == [i * 1000 for i in range(20)]
    assert jsonl.broken(jsonl.read_lines(spark, str(tmp_path / "done"))).count() == 0


def test_unknown_signals_and_missing_headers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"log_version":1}\n\n{"t":1.5,"f":1,"s":"nope","k":[],"v":null,"c":0.5}\n')
    (tmp_path / "b.jsonl").write_text('{"t":1.5,"f":1,"s":"arm","k":["2"],"v":null,"c":0.5}\n')
    lines = jsonl.read_lines(spark, str(tmp_path))
    assert [r.problem for r in jsonl.broken(lines).collect()] == ["no header"]
    with pytest.raises(Exception, match="unknown signal"):
        jsonl.observations(lines).collect()


def test_stream_equals_batch_for_any_batch_size(spark, tmp_path):
    rnd = random.Random(9)
    rows = sorted((rnd.randint(0, 2), rnd.randint(0, 500)) for _ in range(120))
    rows = [(log, t, i) for i, (log, t) in enumerate(sorted(rows, key=lambda x: x[1]))]
    schema = "log_id int, t_us long, pos long"
    want = sorted(tuple(r) for r in sessions.greedy_cadence(spark.createDataFrame(rows, schema), 40).select("log_id", "t_us", "pos").collect())
    for n, size in (("one", 120), ("many", 30)):
        folder = tmp_path / n
        for i in range(0, len(rows), size):
            spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(str(folder))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000 if size == 120 else 1).parquet(str(folder))
        due = sessions.greedy_cadence_stream(source, 40)
        run = due.writeStream.format("memory").queryName(f"due_{n}").outputMode("append").option("checkpointLocation", str(tmp_path / f"cp_{n}")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert sorted(tuple(r) for r in spark.table(f"due_{n}").collect()) == want


def test_no_operator_plans_a_cartesian_product(spark, sf_dir):
    from chronolane import plans

    for name in ("interval_stab", "interval_overlay", "patch_apply", "asof_left_default", "timeout_tombstones"):
        plan = plans.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
