"""Queries on patches, correction rules, sampling and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import patches as P
from chronolane.operators import rules as R
from chronolane.operators import temporal
from chronolane.streaming import sessions

from .bind import HOUR, OBS, observations, query

KEY = ["signal", "col"]

#: A patch list made from events: every 11th event patches its own key; points, day-long sets and two-hour deletes in turn.
PATCHES = f"""patches AS (SELECT log_id, signal, col, t_us AS start_us, t_us + CASE pos % 3 WHEN 0 THEN 0 WHEN 1 THEN {24 * HOUR} ELSE {2 * HOUR} END AS end_us,
  CASE WHEN pos % 3 = 2 THEN 'delete' ELSE 'set' END AS action, CASE WHEN pos % 3 = 1 THEN k END AS value, pos AS patch_idx FROM obs WHERE pos % 11 = 0)"""
COVER = "CASE WHEN start_us = end_us THEN t_us = start_us ELSE t_us >= start_us AND t_us < end_us END"


def event_patches(obs):
    n = F.col("pos") % 3
    return P.validated(
        obs.where("pos % 11 = 0").select(
            "log_id",
            *KEY,
            F.col("t_us").alias("start_us"),
            (F.col("t_us") + F.when(n == 0, 0).when(n == 1, 24 * HOUR).otherwise(2 * HOUR)).alias("end_us"),
            F.when(n == 2, "delete").otherwise("set").alias("action"),
            F.when(n == 1, F.col("k")).alias("value"),
            F.col("pos").alias("patch_idx"),
        )
    )


@query(f"WITH {OBS}, {PATCHES} SELECT patch_idx, COUNT(*) AS covered FROM obs JOIN patches USING (log_id, signal, col) WHERE {COVER} GROUP BY patch_idx")
def patch_covers_predicate(spark, sf_dir):
    obs = observations(spark, sf_dir)
    hit = obs.join(event_patches(obs), ["log_id", *KEY]).where(P.covers(F.col("t_us"), F.col("start_us"), F.col("end_us")))
    return hit.groupBy("patch_idx").agg(F.count(F.lit(1)).alias("covered"))


@query(f"""WITH {OBS}, {PATCHES}, hit AS (SELECT obs.log_id, pos, bool_or(action = 'delete') AS gone, arg_max({{'v': value}}, patch_idx) AS setv FROM obs JOIN patches USING (log_id, signal, col) WHERE {COVER} GROUP BY ALL)
SELECT log_id, pos, CASE WHEN hit.pos IS NULL THEN v ELSE setv.v END AS v FROM obs LEFT JOIN hit USING (log_id, pos) WHERE NOT COALESCE(gone, FALSE)""")
def patch_apply(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return P.apply_patches(obs, event_patches(obs), KEY).select("log_id", "pos", "v")


#: Clicks in four classes, absent under 500; 0 is neutral.
CLASSED = "c AS (SELECT log_id, col, t_us, pos, frame, signal, score, CASE WHEN v IS NOT NULL THEN CASE WHEN v < 2500 THEN 0 ELSE v // 5000 END END AS v FROM obs)"
ISLANDS = """i0 AS (SELECT *, COALESCE(LEAD(t_us) OVER w, t_us + (t_us - LAG(t_us) OVER w), t_us) AS re FROM (SELECT *, {kind} AS kind FROM {src} WHERE signal = '{signal}') WINDOW w AS (PARTITION BY log_id, col ORDER BY t_us, pos)),
i1 AS (SELECT *, CASE WHEN pos = FIRST_VALUE(pos) OVER w OR kind IS DISTINCT FROM LAG(kind) OVER w THEN 1 ELSE 0 END AS nw FROM i0 WINDOW w AS (PARTITION BY log_id, col ORDER BY t_us, pos)),
i2 AS (SELECT *, SUM(nw) OVER (PARTITION BY log_id, col ORDER BY t_us, pos) AS grp FROM i1),
sp AS (SELECT log_id, col, grp, ANY_VALUE(kind) AS kind, MIN(t_us) AS start_us, MAX(re) AS end_us FROM i2 GROUP BY ALL),
spans AS (SELECT *, LAG(kind) OVER w AS bk, LEAD(kind) OVER w AS ak, LEAD(start_us) OVER w AS next_us FROM sp WINDOW w AS (PARTITION BY log_id, col ORDER BY grp))"""


def classed(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return obs.withColumn("v", F.when(F.col("v") < 2500, 0).otherwise(F.floor(F.col("v") / 5000)))


@query(f"WITH {OBS}, {CLASSED}, {ISLANDS.format(src='c', signal='click', kind='NULLIF(v, 0)')} SELECT log_id, col, start_us, end_us, 0 AS value FROM spans WHERE kind IS NOT NULL AND end_us - start_us < {4 * HOUR}")
def debounce(spark, sf_dir):
    found = R.Debounce("click", 4 * HOUR, 0).patches(classed(spark, sf_dir), ["col"])
    return found.select("log_id", "col", "start_us", "end_us", "value")


@query(f"WITH {OBS}, {CLASSED}, {ISLANDS.format(src='c', signal='click', kind='NULLIF(v, 0)')} SELECT log_id, col, start_us, next_us AS end_us, bk AS value FROM spans WHERE kind IS NULL AND bk = ak AND next_us - start_us <= {24 * HOUR}")
def fill_gap(spark, sf_dir):
    found = R.FillGap("click", 24 * HOUR, 0).patches(classed(spark, sf_dir), ["col"])
    return found.select("log_id", "col", "start_us", "end_us", "value")


@query(f"""WITH {OBS}, {CLASSED}, {ISLANDS.format(src='c', signal='view', kind='CASE WHEN v >= 1 THEN 2 WHEN v IS NOT NULL THEN 1 ELSE 0 END')}
SELECT log_id, col, start_us, end_us FROM spans WHERE kind = 1 AND NOT COALESCE(bk = 2 AND ak = 2 AND next_us - start_us <= {24 * HOUR}, FALSE)""")
def bracketed_gap(spark, sf_dir):
    found = R.BracketedGap("view", 24 * HOUR, 1).patches(classed(spark, sf_dir), ["col"])
    return found.select("log_id", "col", "start_us", "end_us")


#: Sixteen hours of a log are one frame, so that several keys meet in it.
FRAMED = f"f AS (SELECT log_id, col, t_us, pos, signal, score, t_us // {16 * HOUR} AS frame, k % 4 AS v FROM obs)"


@query(f"WITH {OBS}, {FRAMED} SELECT log_id, col, t_us AS start_us FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY log_id, frame, v ORDER BY score DESC, pos) AS n FROM f WHERE signal = 'error') WHERE n > 1")
def dedupe_by_score(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("frame", F.floor(F.col("t_us") / (16 * HOUR))).withColumn("v", F.col("k") % 4)
    return R.UniqueByScore("error").patches(obs, ["col"]).select("log_id", "col", "start_us")


@query(f"""WITH {OBS}, {CLASSED}, r1 AS (SELECT a.log_id, a.col, a.t_us AS start_us, a.t_us AS end_us, CAST(NULL AS BIGINT) AS value
  FROM (SELECT * FROM c WHERE signal = 'click' AND v IS NOT NULL AND v <> 0) a ASOF LEFT JOIN (SELECT * FROM c WHERE signal = 'signup') b ON a.log_id = b.log_id AND a.col = b.col AND a.t_us >= b.t_us WHERE b.v IS NULL),
c1 AS (SELECT c.* REPLACE (CASE WHEN r1.start_us IS NOT NULL THEN 0 ELSE c.v END AS v) FROM c LEFT JOIN r1 ON c.signal = 'click' AND c.log_id = r1.log_id AND c.col = r1.col AND c.t_us = r1.start_us),
{ISLANDS.format(src='c1', signal='click', kind='NULLIF(v, 0)')}
SELECT 1 AS rule, log_id, col, start_us, end_us, 0 AS value FROM r1
UNION ALL SELECT 2, log_id, col, start_us, end_us, 0 FROM spans WHERE kind IS NOT NULL AND end_us - start_us < {4 * HOUR}""")
def corrections_fold(spark, sf_dir):
    steps = [R.RequiresHeld("click", "signup", 0), R.Debounce("click", 4 * HOUR, 0)]
    found = R.correct(classed(spark, sf_dir), R.from_settings([R.settings(r) for r in steps]), ["col"])
    rule = (F.shiftright("patch_idx", 40) + 1).cast("int")
    return found.select(rule.alias("rule"), "log_id", "col", "start_us", "end_us", "value")


@query(f"""WITH {OBS}, w AS (SELECT *, LAG({{'v': v}}) OVER (PARTITION BY log_id, col ORDER BY t_us, pos) AS p FROM obs WHERE signal = 'view')
SELECT log_id, col, pos, CASE WHEN v IS NOT NULL AND p.v IS NULL THEN 'appeared' ELSE 'changed' END AS why FROM w WHERE p IS NOT NULL AND v IS NOT NULL AND (p.v IS NULL OR p.v // 2500 <> v // 2500)""")
def wake_on_change(spark, sf_dir):
    views = observations(spark, sf_dir).where("signal = 'view'")
    before = F.lag(F.struct("v")).over(temporal.ordered("log_id", "col"))
    w = views.withColumn("p", before).where("p is not null and v is not null")
    changed = F.floor(F.col("p.v") / 2500) != F.floor(F.col("v") / 2500)
    return w.where(F.col("p.v").isNull() | changed).select("log_id", "col", "pos", F.when(F.col("p.v").isNull(), "appeared").otherwise("changed").alias("why"))


@query(f"""WITH RECURSIVE {OBS}, o AS (SELECT log_id, t_us, pos, ROW_NUMBER() OVER (PARTITION BY log_id ORDER BY t_us, pos) AS n FROM obs),
walk(log_id, n, pos, last_us, due) AS (SELECT log_id, n, pos, t_us, TRUE FROM o WHERE n = 1
  UNION ALL SELECT o.log_id, o.n, o.pos, CASE WHEN o.t_us - w.last_us >= {5 * HOUR} THEN o.t_us ELSE w.last_us END, o.t_us - w.last_us >= {5 * HOUR} FROM walk w JOIN o ON o.log_id = w.log_id AND o.n = w.n + 1)
SELECT log_id, pos FROM walk WHERE due""")
def cadence_greedy(spark, sf_dir):
    return sessions.greedy_cadence(observations(spark, sf_dir), 5 * HOUR).select("log_id", "pos")


@query(f"""WITH {OBS}, g0 AS (SELECT *, CASE WHEN pos = FIRST_VALUE(pos) OVER w OR (v IS NULL) <> LAG(v IS NULL) OVER w THEN 1 ELSE 0 END AS nw FROM (SELECT log_id, t_us, pos, CASE WHEN v >= 3000 THEN v END AS v FROM obs WHERE signal = 'view') WINDOW w AS (PARTITION BY log_id ORDER BY t_us, pos)),
g1 AS (SELECT *, SUM(nw) OVER (PARTITION BY log_id ORDER BY t_us, pos) AS grp FROM g0),
g2 AS (SELECT *, MIN(t_us) OVER (PARTITION BY log_id, grp) AS since_us FROM g1),
lost AS (SELECT log_id, grp, since_us, MIN(t_us) AS lost_us FROM g2 WHERE v IS NULL AND grp > 1 AND t_us - since_us >= {6 * HOUR} GROUP BY ALL),
h AS (SELECT *, LEAD(t_us) OVER (PARTITION BY log_id, signal, col ORDER BY t_us, pos) AS until_us FROM obs WHERE signal <> 'view')
SELECT log_id, signal, col, lost_us AS t_us, since_us FROM lost JOIN h USING (log_id) WHERE v IS NOT NULL AND h.t_us <= lost_us AND (until_us IS NULL OR until_us > lost_us)""")
def timeout_tombstones(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("v", F.when((F.col("signal") != "view") | (F.col("v") >= 3000), F.col("v")))
    return sessions.gate_loss_tombstones(obs, "view", 6 * HOUR, ["col"])
