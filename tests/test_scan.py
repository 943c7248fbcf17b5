"""Windows along one long log against the same windows in one piece."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolane.operators import lanes, runs, scan, temporal
from chronolane.plans.temporal import KEY, lane_runs

SCHEMA = "log_id long, col long, t_us long, pos long, frame long, signal string, v long"


def log(spark, seed, n=400, logs=2, gap=5):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 1, 2, 40]) if rnd.random() < 0.97 else gap * 100
        rows.append((rnd.randrange(logs), rnd.randrange(2), t, i, i, rnd.choice(["view", "click", "click", "error", "signup"]), rnd.choice([None, None, 1, 1, 2])))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("width", [7, 10**6])
def test_folds_equal_windows(spark, width):
    obs = log(spark, 1)
    folds = {
        "n": scan.ordinal(),
        "s": scan.total(F.col("pos")),
        "c": scan.carried(F.col("v")),
        "f": scan.coming(F.col("v")),
        "p": scan.previous("v", "t_us"),
        "x": scan.following("v"),
    }
    w = Window.partitionBy("log_id").orderBy("t_us", "pos")
    whole = obs.withColumns(
        {
            "n": F.row_number().over(w).cast("long"),
            "s": F.sum("pos").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "c": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "f": F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
            "p": F.lag(F.struct("v", "t_us")).over(w),
            "x": F.lead(F.struct("v")).over(w),
        }
    )
    same(scan.along(obs, ["log_id"], ["t_us", "pos"], width, **folds), whole)
    same(scan.along(obs, ["log_id"], ["t_us", "pos"], None, **folds), whole)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("width", [1, 13, 10**6])
def test_runs_over_stretches_equal_runs_in_one_piece(spark, seed, width):
    obs = log(spark, seed, n=250)
    shown = runs.own_frames(obs, width).where("signal = 'click'")
    same(runs.own_frames(obs, width), runs.own_frames(obs))
    same(runs.encode_timed(shown, ["col"], width), runs.encode_timed(shown, ["col"]))
    same(runs.encode_timed(shown.withColumn("v", F.when(F.col("pos") > 200, F.col("v"))), ["log_id"][1:], width), runs.encode_timed(shown.withColumn("v", F.when(F.col("pos") > 200, F.col("v"))), []))


@pytest.mark.parametrize("width", [30])
def test_views_over_stretches_equal_views_in_one_piece(spark, width):
    obs = log(spark, 9, n=300)
    same(temporal.carry_forward(obs, KEY, width), temporal.carry_forward(obs, KEY))
    same(temporal.validity(obs, KEY, width), temporal.validity(obs, KEY))
    same(lanes.gate_changes(obs, "view", width), lanes.gate_changes(obs, "view"))
    same(lane_runs(spark, "", obs, width), lane_runs(spark, "", obs))
    left, right = obs.where("signal = 'click'"), obs.where("signal <> 'click'")
    for inclusive in (True, False):
        for forward in (True, False):
            same(temporal.asof(left, right, ["log_id"], ["v"], inclusive, forward, width), temporal.asof(left, right, ["log_id"], ["v"], inclusive, forward))


def test_width_asks_for_stretches_only_where_a_log_is_long(spark):
    obs = log(spark, 3)
    assert scan.width(obs) is None
    found = scan.width(obs, most=50)
    most = obs.groupBy("log_id", F.floor(F.col("t_us") / found)).count().agg(F.max("count")).first()[0]
    assert found >= 1 and most < 250


def test_one_long_log_is_many_tasks(spark, sf_dir):
    from chronolane.plans.temporal import one_log

    obs = one_log(spark, sf_dir)
    whole, day = obs.count(), scan.width(obs, most=20)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would join such small parts again
    try:
        sizes = [len(x) for x in runs.own_frames(obs, day).rdd.glom().collect() if x]
        plain = [len(x) for x in runs.own_frames(obs).rdd.glom().collect() if x]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(plain) == 1 and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < whole / 2


@pytest.mark.parametrize("width", [None, 30])
def test_views_of_frames_at_one_time_equal_those_of_all_frames(spark, width):
    from chronolane.plans.temporal import lanes as L

    obs = log(spark, 5, n=200)
    last = obs.agg(F.max("t_us")).first()[0]
    # Frames at one time, the last of each log among them, and frames of two rows that lie between each other.
    obs = obs.withColumn("t_us", F.when(F.col("pos") >= 195, last).otherwise(F.floor(F.col("t_us") / 10) * 10)).withColumn("frame", F.when(F.col("pos") % 5 == 2, F.col("pos") - 2).otherwise(F.col("pos")))
    grid = temporal.frames(obs)
    dense = runs.encode_runs(grid, L.unpivot(grid, temporal.carry_forward(obs, KEY), "view", L.PROJECTORS), ["lane", "col"])
    columns = ["log_id", "lane", "col", "start_us", "end_us", "v"]
    same(lane_runs(spark, "", obs, width).select(*columns), dense.select(*columns))


@pytest.mark.parametrize("width", [None, 30])
def test_state_of_every_frame_equals_a_loop_and_is_not_shuffled(spark, width, monkeypatch):
    from chronolane.plans.temporal import lanes as L

    obs = log(spark, 7, n=150).withColumn("frame", F.when(F.col("pos") % 5 == 2, F.col("pos") - 2).otherwise(F.col("pos"))).cache()
    rows = obs.collect()
    first = {}
    for r in rows:
        f = (r.log_id, r.frame, r.t_us)
        first[f] = min(first.get(f, r.pos), r.pos)
    state, want, count = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r.log_id, r.t_us, first[r.log_id, r.frame, r.t_us], r.pos)):
        f = (r.log_id, r.frame, r.t_us)
        if f not in want:
            count[r.log_id] = count.get(r.log_id, 0) + 1
        state[r.log_id, r.signal, r.col] = (r.t_us, r.v)
        want[f] = (count[r.log_id], [(s, c, t, v) for (log_id, s, c), (t, v) in state.items() if log_id == r.log_id and v is not None])
    held = temporal.carry_forward(obs, KEY, width)
    assert sorted(map(tuple, held.collect())) == sorted((*f, fo, *h) for f, (fo, hs) in want.items() for h in hs)
    states = temporal.states(obs, KEY, width)
    got = {(r.log_id, r.fo, r.lane, r.col, r.v) for r in L.unpivot_states(states, "view", L.PROJECTORS).collect()}
    grid = temporal.frames(obs)
    assert got == {tuple(r) for r in L.unpivot(grid, held, "view", L.PROJECTORS).collect()}
    for df in (temporal.carry_forward(obs, KEY, width), L.frame_records(states), L.unpivot_states(states, "view", L.PROJECTORS)):
        behind = df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
        assert len(behind) == 2 and "Exchange" not in behind[0]


def test_patches_and_gap_means_need_one_shuffle(spark, tmp_path):
    from chronolane.plans import rules, summary

    spark.createDataFrame([(1, y) for y in (5, 5, 100, 301, 700, 801)] + [(2, 9)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = summary.cluster_gap_mean(spark, str(tmp_path))
    plans = [got._jdf.queryExecution().executedPlan().toString(), rules.patch_apply(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()]
    assert [p.count("Exchange hash") + p.count("Exchange range") for p in plans] == [1, 1] and "Aggregate" not in plans[0] and "Join" not in plans[1]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 52), (1, 2, 301), (1, 3, 750), (2, 1, 9)]


def test_overlay_of_one_log_makes_its_runs_in_stretches(spark, sf_dir, monkeypatch):
    from chronolane.plans import temporal as plans

    widths, plain = [], runs.own_frames
    monkeypatch.setattr(runs, "own_frames", lambda obs, width=None: widths.append(width) or plain(obs, width))
    plans.interval_overlay_one_log(spark, sf_dir)
    assert widths and None not in widths
