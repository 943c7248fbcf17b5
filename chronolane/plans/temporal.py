"""Queries on point-in-time state, runs and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolane.operators import intervals, lanes, runs, scan, temporal

from .bind import HOUR, MID, OBS, middle, observations, query, table

KEY = ["signal", "col"]

SNAP = "SELECT o.*, ROW_NUMBER() OVER (PARTITION BY o.log_id, signal, col ORDER BY t_us DESC, pos DESC) AS rn FROM obs o JOIN mid USING (log_id) WHERE t_us <= at_us"


@query(f"WITH {OBS}, {MID} SELECT log_id, signal, col, t_us, v FROM ({SNAP}) WHERE rn = 1 AND v IS NOT NULL")
def query_state_at(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return temporal.snapshot(obs, middle(obs), KEY).select("log_id", "signal", "col", "t_us", "v")


@query(f"""WITH {OBS}, {MID}, fr AS (SELECT log_id, arg_max(frame, t_us) AS frame FROM obs JOIN mid USING (log_id) WHERE t_us <= at_us GROUP BY log_id)
SELECT log_id, frame, t_us, signal, col, v FROM obs JOIN fr USING (log_id, frame)""")
def query_fresh_at(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return temporal.frame_at(obs, middle(obs)).select("log_id", "frame", "t_us", "signal", "col", "v")


@query(f"""WITH {OBS}, {MID}, held AS (SELECT * FROM ({SNAP}) WHERE rn = 1 AND v IS NOT NULL),
gate AS (SELECT DISTINCT log_id FROM held WHERE signal = 'view')
SELECT log_id, signal AS lane, col, CASE WHEN signal <> 'error' THEN v END AS v FROM held SEMI JOIN gate USING (log_id) WHERE signal <> 'view'
UNION ALL SELECT log_id, 'no_ui', 0, NULL FROM mid ANTI JOIN gate USING (log_id)""")
def query_lanes_at(spark, sf_dir):
    obs = observations(spark, sf_dir)
    at = middle(obs)
    state = temporal.snapshot(obs, at, KEY).withColumn("fo", F.lit(1))
    logs = at.select("log_id", F.lit(1).alias("fo"))
    return lanes.unpivot(logs, state, "view", lanes.PROJECTORS).drop("fo")


@query(f"""WITH {OBS}, fr AS (SELECT log_id, frame, t_us, pos FROM obs), keys AS (SELECT DISTINCT log_id, col FROM obs WHERE signal = 'purchase'),
dense AS (SELECT fr.*, keys.col, o.pos AS hit, o.t_us AS ht, o.v AS hv FROM fr JOIN keys USING (log_id)
  LEFT JOIN obs o ON o.log_id = fr.log_id AND o.frame = fr.frame AND o.col = keys.col AND o.signal = 'purchase'),
held AS (SELECT *, last_value(CASE WHEN hit IS NOT NULL THEN {{'t': ht, 'v': hv}} END IGNORE NULLS) OVER (PARTITION BY log_id, col ORDER BY t_us, pos) AS h FROM dense)
SELECT log_id, frame, col, h.t AS since_us, h.v AS v FROM held WHERE h.v IS NOT NULL""")
def carry_forward_state(spark, sf_dir):
    obs = observations(spark, sf_dir)
    held = temporal.states(obs, ["col"], scan.width(obs), F.col("signal") == "purchase")
    return held.select("log_id", "frame", F.inline("held")).select("log_id", "frame", "col", "since_us", "v")


@query(f"""WITH {OBS}, c AS (SELECT * FROM obs WHERE signal = 'click'), r AS (SELECT * FROM obs WHERE signal = 'view')
SELECT c.log_id, c.pos, c.col, COALESCE(r.k, c.col) AS digit FROM c ASOF LEFT JOIN r ON c.log_id = r.log_id AND c.col = r.col AND c.t_us >= r.t_us""")
def asof_left_default(spark, sf_dir):
    obs = observations(spark, sf_dir)
    got = temporal.asof(obs.where("signal = 'click'"), obs.where("signal = 'view'"), ["log_id", "col"], ["k"])
    return got.select("log_id", "pos", "col", F.coalesce("got.k", "col").alias("digit"))


@query(f"""WITH {OBS}, c AS (SELECT * FROM obs WHERE signal = 'purchase'), r AS (SELECT * FROM obs WHERE signal = 'signup')
SELECT c.log_id, c.pos, c.col FROM c ASOF LEFT JOIN r ON c.log_id = r.log_id AND c.col = r.col AND c.t_us >= r.t_us WHERE r.v IS NULL""")
def asof_anti(spark, sf_dir):
    obs = observations(spark, sf_dir)
    got = temporal.asof(obs.where("signal = 'purchase'"), obs.where("signal = 'signup'"), ["log_id", "col"], ["v"])
    return got.where("got.v is null").select("log_id", "pos", "col")


@query(f"""WITH {OBS}, c AS (SELECT * FROM obs WHERE signal = 'purchase'), r AS (SELECT * FROM obs WHERE signal = 'signup')
SELECT c.log_id, c.pos, c.col, r.k FROM c ASOF JOIN r ON c.log_id = r.log_id AND c.col = r.col AND c.t_us >= r.t_us
JOIN part ON p_partkey = r.k WHERE r.v IS NOT NULL AND p_size % 3 = 0""")
def asof_semi_dim(spark, sf_dir):
    obs = observations(spark, sf_dir)
    got = temporal.asof(obs.where("signal = 'purchase'"), obs.where("signal = 'signup'"), ["log_id", "col"], ["k", "v"])
    silent = table(spark, sf_dir, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("k"))
    held = got.where("got.v is not null").select("log_id", "pos", "col", F.col("got.k").alias("k"))
    return held.join(silent, "k", "left_semi").select("log_id", "pos", "col", "k")


@query(f"""WITH {OBS}, e AS (SELECT * FROM obs WHERE signal = 'error'), g AS (SELECT log_id, t_us FROM obs WHERE signal = 'view'),
sp AS (SELECT log_id, (MAX(t_us) - MIN(t_us)) // (COUNT(*) - 1) AS spacing FROM g GROUP BY log_id),
b AS (SELECT e.log_id, e.pos, e.t_us, g.t_us AS before_us FROM e ASOF LEFT JOIN g ON e.log_id = g.log_id AND e.t_us > g.t_us),
a AS (SELECT b.*, g.t_us AS after_us FROM b ASOF LEFT JOIN g ON b.log_id = g.log_id AND b.t_us < g.t_us)
SELECT log_id, pos, COALESCE(before_us, t_us) AS start_us, COALESCE(after_us, t_us + spacing) AS end_us FROM a LEFT JOIN sp USING (log_id)""")
def asof_grid_snap(spark, sf_dir):
    from chronolane.operators.privacy import snapped

    obs = observations(spark, sf_dir)
    found = obs.where("signal = 'error'").select("log_id", F.col("pos").alias("id"), F.col("t_us").alias("first_us"), F.col("t_us").alias("last_us"))
    return snapped(found, obs.where("signal = 'view'"), ["log_id"]).select("log_id", F.col("id").alias("pos"), "start_us", "end_us")


# Runs: each event is a frame, its column is the lane, hundreds of units are the value.
RUNS = """fr AS (SELECT log_id, t_us, pos, col, {v} AS v, ROW_NUMBER() OVER (PARTITION BY log_id ORDER BY t_us, pos) AS fo FROM {src}),
nx AS (SELECT *, COALESCE(LEAD(t_us) OVER w, t_us + (t_us - LAG(t_us) OVER w), t_us) AS nxt FROM fr WINDOW w AS (PARTITION BY log_id ORDER BY fo)),
i1 AS (SELECT *, fo - ROW_NUMBER() OVER (PARTITION BY log_id, col ORDER BY fo) AS isl FROM nx),
i2 AS (SELECT *, COALESCE(last_value(v IGNORE NULLS) OVER (PARTITION BY log_id, col, isl ORDER BY fo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY log_id, col, isl ORDER BY fo ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS vf FROM i1),
i3 AS (SELECT *, CASE WHEN fo = MIN(fo) OVER (PARTITION BY log_id, col, isl) THEN 0 WHEN vf IS DISTINCT FROM LAG(vf) OVER (PARTITION BY log_id, col, isl ORDER BY fo) THEN 1 ELSE 0 END AS chg FROM i2),
i4 AS (SELECT *, SUM(chg) OVER (PARTITION BY log_id, col, isl ORDER BY fo) AS run FROM i3),
runs AS (SELECT log_id, col, MIN(t_us) AS start_us, arg_max(nxt, fo) AS end_us, MIN(vf) AS v FROM i4 GROUP BY log_id, col, isl, run)"""
EVENT_RUNS = RUNS.format(src="obs", v="v // 2500")
RUN_COLUMNS = ["log_id", "col", "start_us", "end_us", "v"]


def event_runs(spark, sf_dir, obs=None, width=None):
    obs = observations(spark, sf_dir) if obs is None else obs
    shown = runs.own_frames(obs, width).select("log_id", "fo", "t_us", "nxt", "col", F.floor(F.col("v") / 2500).alias("v"))
    return runs.encode_timed(shown, ["col"], width).select(*RUN_COLUMNS)


@query(f"WITH {OBS}, {EVENT_RUNS} SELECT log_id, col, start_us, end_us, v FROM runs")
def runs_encode(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return event_runs(spark, sf_dir, obs, scan.width(obs))


@query(f"WITH {OBS}, {RUNS.format(src='obs', v='CASE WHEN k >= 50 THEN k // 25 END')} SELECT log_id, col, COUNT(*) AS n_runs, COUNT(*) FILTER (v IS NULL) AS unresolved, CAST(SUM(end_us - start_us) AS BIGINT) AS total_us FROM runs GROUP BY ALL")
def runs_pending_backfill(spark, sf_dir):
    obs = observations(spark, sf_dir)
    grid = temporal.frames(obs)
    waiting = F.when(F.col("k") >= 50, F.floor(F.col("k") / 25))
    shown = obs.join(grid.select("log_id", "frame", "fo"), ["log_id", "frame"]).select("log_id", "fo", "col", waiting.alias("v"))
    found = runs.encode_runs(grid, shown, ["col"])
    return found.groupBy("log_id", "col").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("v").isNull()).alias("unresolved"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us")
    )


@query(f"""WITH {OBS} SELECT log_id, signal, col, pos, COALESCE(LEAD(t_us) OVER w, t_us + (t_us - LAG(t_us) OVER w), t_us) AS end_us FROM obs
WINDOW w AS (PARTITION BY log_id, signal, col ORDER BY t_us, pos)""")
def run_end_borrow(spark, sf_dir):
    w = temporal.ordered("log_id", *KEY)
    end = temporal.last_sample_end(F.col("t_us"), F.lead("t_us").over(w), F.lag("t_us").over(w))
    return observations(spark, sf_dir).select("log_id", "signal", "col", "pos", end.alias("end_us"))


STATE = """fr AS (SELECT log_id, frame, t_us, ROW_NUMBER() OVER (PARTITION BY log_id ORDER BY t_us, pos) AS fo FROM obs),
keys AS (SELECT DISTINCT log_id, signal, col FROM obs),
dense AS (SELECT fr.*, keys.signal, keys.col, o.pos AS hit, o.t_us AS ht, o.v AS hv FROM fr JOIN keys USING (log_id)
  LEFT JOIN obs o ON o.log_id = fr.log_id AND o.frame = fr.frame AND o.signal = keys.signal AND o.col = keys.col),
held AS (SELECT *, last_value(CASE WHEN hit IS NOT NULL THEN {'t': ht, 'v': hv} END IGNORE NULLS) OVER (PARTITION BY log_id, signal, col ORDER BY fo) AS h FROM dense),
state AS (SELECT log_id, frame, t_us, fo, signal, col, h.t AS since_us, h.v AS v FROM held WHERE h.v IS NOT NULL),
gate AS (SELECT DISTINCT log_id, fo FROM state WHERE signal = 'view'),
painted AS (SELECT log_id, fo, signal AS lane, col, CASE WHEN signal <> 'error' THEN v END AS v FROM state SEMI JOIN gate USING (log_id, fo) WHERE signal <> 'view'
  UNION ALL SELECT log_id, fo, 'no_ui', 0, NULL FROM fr ANTI JOIN gate USING (log_id, fo))"""
LANE_RUNS = """nx AS (SELECT *, COALESCE(LEAD(t_us) OVER w, t_us + (t_us - LAG(t_us) OVER w), t_us) AS nxt FROM fr WINDOW w AS (PARTITION BY log_id ORDER BY fo)),
i1 AS (SELECT p.*, nx.t_us, nx.nxt, fo - ROW_NUMBER() OVER (PARTITION BY log_id, lane, col ORDER BY fo) AS isl FROM painted p JOIN nx USING (log_id, fo)),
i2 AS (SELECT *, COALESCE(last_value(v IGNORE NULLS) OVER (PARTITION BY log_id, lane, col, isl ORDER BY fo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY log_id, lane, col, isl ORDER BY fo ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS vf FROM i1),
i3 AS (SELECT *, CASE WHEN fo = MIN(fo) OVER (PARTITION BY log_id, lane, col, isl) THEN 0 WHEN vf IS DISTINCT FROM LAG(vf) OVER (PARTITION BY log_id, lane, col, isl ORDER BY fo) THEN 1 ELSE 0 END AS chg FROM i2),
i4 AS (SELECT *, SUM(chg) OVER (PARTITION BY log_id, lane, col, isl ORDER BY fo) AS run FROM i3),
lane_runs AS (SELECT log_id, lane, col, MIN(t_us) AS start_us, arg_max(nxt, fo) AS end_us, MIN(vf) AS v FROM i4 GROUP BY log_id, lane, col, isl, run)"""


def lane_runs(spark, sf_dir, obs=None, width=None):
    obs = observations(spark, sf_dir) if obs is None else obs
    ends = lanes.closes(obs)
    changes = lanes.lane_changes(obs, "view", lanes.PROJECTORS, ends, width)
    return runs.encode_changes(changes, ends.select("log_id", "close_us"), ["lane", "col"], width)


@query(f"WITH {OBS}, {STATE}, {LANE_RUNS} SELECT log_id, lane, col, start_us, end_us, v FROM lane_runs")
def interval_view(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return lane_runs(spark, sf_dir, obs, scan.width(obs)).select("log_id", "lane", "col", "start_us", "end_us", "v")


@query(f"WITH {OBS}, {STATE} SELECT lane, COUNT(*) AS shown, COUNT(v) AS valued, CAST(SUM(v) AS BIGINT) AS total FROM painted GROUP BY lane")
def lanes_unpivot(spark, sf_dir):
    obs = observations(spark, sf_dir)
    painted = lanes.unpivot_states(temporal.states(obs, KEY, scan.width(obs)), "view", lanes.PROJECTORS)
    return painted.groupBy("lane").agg(F.count(F.lit(1)).alias("shown"), F.count("v").alias("valued"), F.sum("v").alias("total"))


@query(f"WITH {OBS}, {STATE} SELECT log_id, frame, COUNT(*) AS n_held, COUNT(*) FILTER (since_us < t_us) AS n_carried, CAST(SUM(v) AS BIGINT) AS total FROM state GROUP BY log_id, frame")
def frame_view_nested(spark, sf_dir):
    obs = observations(spark, sf_dir)
    records = lanes.frame_records(temporal.states(obs, KEY, scan.width(obs)))
    carried = F.filter("held", lambda h: h["observed_us"].isNotNull())
    total = F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + h["v"])
    return records.select("log_id", "frame", F.size("held").cast("long").alias("n_held"), F.size(carried).cast("long").alias("n_carried"), total.alias("total"))


@query(f"WITH {OBS}, {MID}, {EVENT_RUNS} SELECT log_id, col, start_us, end_us, v FROM runs JOIN mid USING (log_id) WHERE start_us <= at_us AND at_us < end_us")
def interval_stab(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return intervals.stab(event_runs(spark, sf_dir, obs), middle(obs), ["log_id"], 24 * HOUR).select(*RUN_COLUMNS)


#: Runs made longer, so that they overlap and touch.
LONGER = f"longer AS (SELECT log_id, col, start_us, start_us + (v + 1) * {HOUR} AS end_us, v FROM runs WHERE v IS NOT NULL)"


def longer_runs(spark, sf_dir, obs=None, width=None):
    found = event_runs(spark, sf_dir, obs, width).where("v is not null")
    return found.withColumn("end_us", F.col("start_us") + (F.col("v") + 1) * HOUR)


@query(f"""WITH {OBS}, {EVENT_RUNS}, {LONGER}, m AS (SELECT *, MAX(end_us) OVER (PARTITION BY log_id, col ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM longer),
g AS (SELECT *, SUM(CASE WHEN start_us < reach THEN 0 ELSE 1 END) OVER (PARTITION BY log_id, col ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS grp FROM m)
SELECT log_id, col, MIN(start_us) AS start_us, MAX(end_us) AS end_us, COUNT(*) AS n FROM g GROUP BY log_id, col, grp""")
def interval_merge_overlap(spark, sf_dir):
    return intervals.merge_overlapping(longer_runs(spark, sf_dir), ["log_id", "col"])


@query(f"WITH {OBS}, {EVENT_RUNS}, {LONGER} SELECT log_id, start_us AS at_us FROM longer UNION SELECT log_id, end_us FROM longer")
def interval_boundaries(spark, sf_dir):
    return intervals.boundaries(longer_runs(spark, sf_dir), ["log_id"])


@query(f"""WITH {OBS}, {MID}, {EVENT_RUNS}, {LONGER}, b AS (SELECT log_id, start_us AS t FROM longer UNION SELECT log_id, end_us FROM longer)
SELECT log_id, at_us, MIN(t) AS next_us FROM mid LEFT JOIN b USING (log_id) WHERE t > at_us OR t IS NULL GROUP BY log_id, at_us""")
def interval_next_event(spark, sf_dir):
    return intervals.next_event(longer_runs(spark, sf_dir), middle(observations(spark, sf_dir)), ["log_id"])


@query(f"""WITH {OBS}, {EVENT_RUNS}, {LONGER}, b AS (SELECT log_id, start_us AS t FROM longer UNION SELECT log_id, end_us FROM longer),
s AS (SELECT log_id, t AS from_us, LEAD(t) OVER (PARTITION BY log_id ORDER BY t) AS to_us FROM b)
SELECT s.log_id, l.col AS layer, from_us, to_us, arg_max(l.v, (l.start_us, l.v)) AS v FROM s JOIN longer l ON l.log_id = s.log_id AND l.start_us <= from_us AND to_us <= l.end_us
WHERE to_us IS NOT NULL GROUP BY ALL""")
def interval_overlay(spark, sf_dir):
    obs = observations(spark, sf_dir)
    width = scan.width(obs)
    return intervals.overlay(longer_runs(spark, sf_dir, obs, width).withColumnRenamed("col", "layer"), ["log_id"], width)


@query(f"""WITH {OBS}, s AS (SELECT *, MIN(t_us) OVER (PARTITION BY log_id) AS t0 FROM obs),
b AS (SELECT *, CAST(FLOOR((t_us - t0) / 1000000.0 * (1.0 / 7200) + 1e-6) AS BIGINT) AS tick FROM s)
SELECT log_id, tick, arg_min(pos, (t_us, pos)) AS pos FROM b GROUP BY log_id, tick""")
def sample_first_per_tick(spark, sf_dir):
    return temporal.first_per_tick(observations(spark, sf_dir), ["log_id"], 1.0 / 7200).select("log_id", "tick", "pos")


# One log that holds all rows: the same views, spread over stretches of a day.
DAY = 24 * HOUR
ONE = OBS.replace("user_id % 10 AS log_id", "0::BIGINT AS log_id")


def one_log(spark, sf_dir):
    return observations(spark, sf_dir).withColumn("log_id", F.lit(0).cast("long"))


def one_width(obs):
    """A day, or less where a day has more rows than one task should take."""
    return min(DAY, scan.width(obs) or DAY)


@query(f"WITH {ONE}, {EVENT_RUNS} SELECT log_id, col, start_us, end_us, v FROM runs")
def runs_encode_one_log(spark, sf_dir):
    return event_runs(spark, sf_dir, one_log(spark, sf_dir), DAY)


@query(f"WITH {ONE}, {STATE}, {LANE_RUNS} SELECT log_id, lane, col, start_us, end_us, v FROM lane_runs")
def interval_view_one_log(spark, sf_dir):
    return lane_runs(spark, sf_dir, one_log(spark, sf_dir), DAY).select("log_id", "lane", "col", "start_us", "end_us", "v")


@query(f"WITH {ONE}, {STATE} SELECT log_id, frame, signal, col, since_us, v FROM state")
def carry_forward_one_log(spark, sf_dir):
    obs = one_log(spark, sf_dir)
    return temporal.carry_forward(obs, KEY, one_width(obs)).select("log_id", "frame", "signal", "col", "since_us", "v")


@query(f"""WITH {ONE}, c AS (SELECT * FROM obs WHERE signal = 'click'), r AS (SELECT * FROM obs WHERE signal = 'view'),
b AS (SELECT c.log_id, c.pos, c.t_us, r.k AS before FROM c ASOF LEFT JOIN r ON c.log_id = r.log_id AND c.t_us >= r.t_us)
SELECT b.log_id, b.pos, b.before, r.k AS after FROM b ASOF LEFT JOIN r ON b.log_id = r.log_id AND b.t_us < r.t_us""")
def asof_one_log(spark, sf_dir):
    obs = one_log(spark, sf_dir)
    views = obs.where("signal = 'view'")
    before = temporal.asof(obs.where("signal = 'click'"), views, ["log_id"], ["k"], width=DAY).withColumn("before", F.col("got.k")).drop("got")
    both = temporal.asof(before, views, ["log_id"], ["k"], inclusive=False, forward=True, width=DAY)
    return both.select("log_id", "pos", "before", F.col("got.k").alias("after"))


@query(f"""WITH {ONE}, {EVENT_RUNS}, {LONGER}, b AS (SELECT log_id, start_us AS t FROM longer UNION SELECT log_id, end_us FROM longer),
s AS (SELECT log_id, t AS from_us, LEAD(t) OVER (PARTITION BY log_id ORDER BY t) AS to_us FROM b)
SELECT s.log_id, l.col AS layer, from_us, to_us, arg_max(l.v, (l.start_us, l.v)) AS v FROM s JOIN longer l ON l.log_id = s.log_id AND l.start_us <= from_us AND to_us <= l.end_us
WHERE to_us IS NOT NULL GROUP BY ALL""")
def interval_overlay_one_log(spark, sf_dir):
    obs = one_log(spark, sf_dir)
    width = one_width(obs)
    return intervals.overlay(longer_runs(spark, sf_dir, obs, width).withColumnRenamed("col", "layer"), ["log_id"], width)
