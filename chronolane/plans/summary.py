"""Queries on summaries and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolane.functions import geometry
from chronolane.operators import lanes, summary, temporal

from .bind import HOUR, OBS, observations, query, table
from .temporal import EVENT_RUNS, KEY, LANE_RUNS, STATE, event_runs, lane_runs

LANES = {"click": "click", "error": "laser", "purchase": "press", "no_ui": "no_ui"}
_totals = ", ".join(f"COUNT(*) FILTER (lane = '{lane}') AS {n}_count, CAST(COALESCE(SUM(end_us - start_us) FILTER (lane = '{lane}'), 0) AS BIGINT) AS {n}_us" for lane, n in LANES.items())


@query(f"""WITH {OBS}, {STATE}, {LANE_RUNS}, t AS (SELECT log_id, COUNT(*) AS intervals, {_totals} FROM lane_runs GROUP BY log_id),
m AS (SELECT *, LAG(v) OVER (PARTITION BY log_id, col ORDER BY start_us) AS b FROM lane_runs WHERE lane = 'signup' AND v IS NOT NULL),
n AS (SELECT log_id, COUNT(DISTINCT v) AS mounts, COUNT(*) FILTER (b <> v) AS changes FROM m GROUP BY log_id)
SELECT t.*, COALESCE(mounts, 0) AS mounts, COALESCE(changes, 0) AS changes FROM t LEFT JOIN n USING (log_id)""")
def summary_fold(spark, sf_dir):
    return summary.summarize(lane_runs(spark, sf_dir), LANES, "signup")


#: Event runs under one lane name.
USES = "u AS (SELECT * FROM runs WHERE v IS NOT NULL)"


def one_lane(spark, sf_dir):
    return event_runs(spark, sf_dir).withColumn("lane", F.lit("use"))


@query(f"""WITH {OBS}, {EVENT_RUNS}, {USES}, f AS (SELECT log_id, v, CAST(SUM(end_us - start_us) AS BIGINT) AS duration_us, MIN((start_us, col)) AS fst, string_agg(DISTINCT CAST(col AS VARCHAR), ',' ORDER BY CAST(col AS VARCHAR)) AS cols FROM u GROUP BY log_id, v)
SELECT log_id, v, ROW_NUMBER() OVER (PARTITION BY log_id ORDER BY fst, v) AS place, duration_us, cols FROM f""")
def agg_first_appearance(spark, sf_dir):
    return summary.uses(one_lane(spark, sf_dir), "use")


@query(f"WITH {OBS}, {EVENT_RUNS}, {USES}, c AS (SELECT *, LAG(v) OVER (PARTITION BY log_id, col ORDER BY start_us) AS b FROM u) SELECT log_id, COUNT(*) FILTER (b <> v) AS changes FROM c GROUP BY log_id")
def agg_change_count(spark, sf_dir):
    return summary.changes(one_lane(spark, sf_dir), "use")


@query(f"""WITH {OBS}, {EVENT_RUNS}, logs AS (SELECT DISTINCT log_id FROM obs), g AS (SELECT log_id, x AS col FROM logs, (SELECT UNNEST([1, 2, 3, 4, 5]) AS x))
SELECT g.log_id, g.col, COUNT(r.start_us) AS n, CAST(COALESCE(SUM(end_us - start_us), 0) AS BIGINT) AS duration_us FROM g LEFT JOIN runs r ON r.log_id = g.log_id AND r.col = g.col AND r.v >= 6 GROUP BY ALL""")
def agg_dense_groups(spark, sf_dir):
    found = event_runs(spark, sf_dir)
    grid = observations(spark, sf_dir).select("log_id").distinct().withColumn("col", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    sums = found.where("v >= 6").groupBy("log_id", "col").agg(F.count(F.lit(1)).alias("n"), F.sum(summary.span()).alias("duration_us"))
    return grid.join(sums, ["log_id", "col"], "left").fillna(0, ["n", "duration_us"])


@query(f"WITH {OBS}, {EVENT_RUNS}, {USES} SELECT col, v, COUNT(*) AS n FROM u GROUP BY GROUPING SETS ((v), (col, v))")
def agg_grouping_sets(spark, sf_dir):
    found = event_runs(spark, sf_dir).where("v is not null")
    return found.groupingSets([[F.col("v")], [F.col("col"), F.col("v")]], "col", "v").agg(F.count(F.lit(1)).alias("n")).select("col", "v", "n")


@query(f"""WITH {OBS}, {EVENT_RUNS}, n AS (SELECT log_id, CASE WHEN col < 4 THEN col END AS arm, v, end_us - start_us AS d FROM runs)
SELECT arm, v, COUNT(*) AS n, CAST(SUM(d) AS BIGINT) AS duration_us, ROW_NUMBER() OVER (ORDER BY arm NULLS LAST, v NULLS LAST) AS place FROM n GROUP BY arm, v""")
def agg_null_groups(spark, sf_dir):
    arm = F.when(F.col("col") < 4, F.col("col"))
    groups = event_runs(spark, sf_dir).groupBy(arm.alias("arm"), "v").agg(F.count(F.lit(1)).alias("n"), F.sum(summary.span()).alias("duration_us"))
    # One row for each arm and value class, a few dozen, go through one window.
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("arm"), F.asc_nulls_last("v"))))


@query(f"WITH {OBS}, {EVENT_RUNS} SELECT log_id, COUNT(*) AS n, string_agg(DISTINCT CAST(v AS VARCHAR), ',' ORDER BY CAST(v AS VARCHAR)) AS texts FROM runs GROUP BY log_id")
def agg_collect_set(spark, sf_dir):
    texts = F.array_join(F.sort_array(F.collect_set(F.col("v").cast("string"))), ",")
    return event_runs(spark, sf_dir).groupBy("log_id").agg(F.count(F.lit(1)).alias("n"), texts.alias("texts"))


@query(f"""WITH {OBS}, d AS (SELECT log_id, COUNT(*) AS observations, COUNT(*) FILTER (signal = 'view') AS n, MAX(t_us) FILTER (signal = 'view') - MIN(t_us) FILTER (signal = 'view') AS span FROM obs GROUP BY log_id)
SELECT log_id, observations, n AS frames_sampled, CASE WHEN span > 0 THEN ROUND((n - 1) * 3600000000.0::DOUBLE / span, 3) ELSE 0.0 END AS achieved_per_hour FROM d""")
def agg_footer_digest(spark, sf_dir):
    return summary.footer(observations(spark, sf_dir), "view")


@query(f"WITH {OBS} SELECT log_id, (MAX(t_us) - MIN(t_us)) // (COUNT(*) - 1) AS spacing_us FROM obs WHERE signal = 'view' GROUP BY log_id HAVING COUNT(*) > 1")
def agg_mean_spacing(spark, sf_dir):
    grid = observations(spark, sf_dir).where("signal = 'view'").groupBy("log_id").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"), F.count(F.lit(1)).alias("n"))
    return grid.where("n > 1").select("log_id", F.expr("(b - a) DIV (n - 1)").alias("spacing_us"))


@query("""WITH t AS (SELECT 'brand' AS kind, p_brand AS label, p_partkey AS ord FROM part UNION ALL SELECT 'type', p_type, p_partkey FROM part UNION ALL SELECT 'name', upper(p_name), p_partkey FROM part)
SELECT kind, lower(label) AS needle, arg_min(label, ord) AS label, COUNT(*) AS n FROM t GROUP BY kind, lower(label)""")
def agg_vocabulary(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = part.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(k).alias("kind"), c.alias("label")) for k, c in (("brand", F.col("p_brand")), ("type", F.col("p_type")), ("name", F.upper("p_name")))]
            )
        ).alias("w"),
        F.col("p_partkey").alias("ord"),
    ).select("w.*", "ord")
    return words.groupBy("kind", F.lower("label").alias("needle")).agg(F.min_by("label", "ord").alias("label"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {OBS} SELECT log_id, COALESCE(string_agg(DISTINCT CAST(col AS VARCHAR), ',' ORDER BY CAST(col AS VARCHAR)) FILTER (v > 40000), '1,2,3,4') AS arms FROM obs GROUP BY log_id")
def agg_distinct_default(spark, sf_dir):
    seen = F.sort_array(F.collect_set(F.when(F.col("v") > 40000, F.col("col").cast("string"))))
    arms = observations(spark, sf_dir).groupBy("log_id").agg(seen.alias("a"))
    return arms.select("log_id", F.when(F.size("a") == 0, "1,2,3,4").otherwise(F.array_join("a", ",")).alias("arms"))


@query("""WITH o AS (SELECT l_orderkey, COUNT(*) AS n, MAX(l_quantity) AS tallest, SUM(l_quantity) AS s, arg_min(l_linenumber, (-l_quantity, l_linenumber)) AS line FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 1)
SELECT l_orderkey, line, ROUND((s - tallest) / (n - 1), 6) AS others, tallest * (n - 1) >= 1.15 * (s - tallest) AS stands_out FROM o""")
def agg_leave_one_out(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("tallest"), F.sum("l_quantity").alias("s"), F.min_by("l_linenumber", F.struct(-F.col("l_quantity"), "l_linenumber")).alias("line")
    )
    rest = F.col("s") - F.col("tallest")
    return each.where("n > 1").select(
        "l_orderkey", "line", F.round(rest / (F.col("n") - 1), 6).alias("others"), (F.col("tallest") * (F.col("n") - 1) >= 1.15 * rest).alias("stands_out")
    )


#: Boxes from line items: place by key, size by quantity and line.
BOXES = "b AS (SELECT l_orderkey, l_linenumber, l_partkey % 1600 AS x, l_suppkey % 900 AS y, CAST(l_quantity AS BIGINT) + 20 AS w, CAST(l_linenumber AS BIGINT) * 10 AS h FROM lineitem)"


def boxes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        geometry.box(F.col("l_partkey") % 1600, F.col("l_suppkey") % 900, F.col("l_quantity").cast("long") + 20, F.col("l_linenumber").cast("long") * 10).alias("box"),
    )


@query(f"WITH {BOXES} SELECT l_orderkey, MIN(x) AS x, MIN(y) AS y, MAX(x + w) - MIN(x) AS w, MAX(y + h) - MIN(y) AS h FROM b GROUP BY l_orderkey")
def agg_bounding_box(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("l_orderkey").agg(*geometry.union_box("box"))


@query(f"WITH {BOXES} SELECT l_orderkey, l_linenumber, x + 160 AS x, y + 90 AS y, x + w AS right_edge, w >= 0.02 * 1600 AS wide FROM b")
def geo_box_ops(spark, sf_dir):
    region = geometry.box(F.lit(160), F.lit(90), F.lit(1600), F.lit(900))
    moved = boxes(spark, sf_dir).withColumn("m", geometry.offset(F.col("box"), region))
    back = geometry.from_corners(F.col("box.x"), F.col("box.y"), F.col("box.x") + F.col("box.w"), F.col("box.y") + F.col("box.h"))
    return moved.withColumn("c", back).select("l_orderkey", "l_linenumber", "m.x", "m.y", (F.col("c.x") + F.col("c.w")).alias("right_edge"), (F.col("box.w") >= 0.02 * 1600).alias("wide"))


@query(f"WITH {BOXES}, i AS (SELECT UNNEST([0, 1, 2, 3]) AS i) SELECT l_orderkey, l_linenumber, CAST(i + 1 AS BIGINT) AS col, x + i * (w // 4) AS left_edge, CASE WHEN i = 3 THEN w - 3 * (w // 4) ELSE w // 4 END AS width FROM b, i")
def geo_column_bounds(spark, sf_dir):
    cut = boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.explode(geometry.column_bounds(F.col("box"))).alias("c"))
    return cut.select("l_orderkey", "l_linenumber", F.col("c.column").alias("col"), F.col("c.x").alias("left_edge"), F.col("c.w").alias("width"))


@query(f"""WITH {BOXES}, c AS (SELECT *, w >= h AS wide, LEAST(w, h) // 2 AS half FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN wide THEN x + half ELSE x + w // 2 END AS x1, CASE WHEN wide THEN y + h // 2 ELSE y + half END AS y1,
 CASE WHEN wide THEN x + w - half ELSE x + w // 2 END AS x2, CASE WHEN wide THEN y + h // 2 ELSE y + h - half END AS y2 FROM c""")
def geo_end_centers(spark, sf_dir):
    return boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.end_centers(F.col("box")).alias("e")).select("l_orderkey", "l_linenumber", "e.*")


#: Sorted integer rows: part keys of an order.
@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_partkey AS y FROM lineitem), g AS (SELECT *, CASE WHEN y - LAG(y) OVER (PARTITION BY l_orderkey ORDER BY y) <= 200 THEN 0 ELSE 1 END AS nw FROM r),
c AS (SELECT *, SUM(nw) OVER (PARTITION BY l_orderkey ORDER BY y) AS grp FROM g) SELECT l_orderkey, grp, CAST(SUM(y) // COUNT(*) AS BIGINT) AS y FROM c GROUP BY l_orderkey, grp""")
def cluster_gap_mean(spark, sf_dir):
    # One shuffle and one sort; all else are windows in that order, so that a task keeps an order's rows and no table of groups.
    w = Window.partitionBy("l_orderkey").orderBy("y")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("y"))
    before = F.struct(F.lag("y").over(w).alias("y"), F.lag(F.lit(True)).over(w).alias("is"))
    once = rows.withColumn("_b", before).where(F.col("_b.is").isNull() | ~F.col("y").eqNullSafe(F.col("_b.y")))
    near = F.when(F.col("y") - F.col("_b.y") <= 200, 0).otherwise(1)
    summed = once.select("l_orderkey", "y", near.alias("nw")).withColumns(
        {"grp": F.sum("nw").over(upto), "_n": F.count(F.lit(1)).over(upto), "_sum": F.sum("y").over(upto), "_then": F.lead("nw").over(w)}
    )
    ends = summed.where("coalesce(_then, 1) = 1")
    own = [F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in ("_sum", "_n")]
    return ends.select("l_orderkey", "grp", own[0].alias("_sum"), own[1].alias("_n")).select("l_orderkey", "grp", F.expr("_sum DIV _n").alias("y"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_partkey AS y FROM lineitem), g AS (SELECT *, y - LAG(y) OVER (PARTITION BY l_orderkey ORDER BY y) > 400 AS far FROM r),
c AS (SELECT *, bool_or(COALESCE(far, FALSE)) OVER (PARTITION BY l_orderkey ORDER BY y) AS past FROM g) SELECT l_orderkey, y FROM c WHERE NOT past""")
def prefix_until_gap(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("y")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("y")).distinct()
    far = rows.withColumn("far", F.coalesce(F.col("y") - F.lag("y").over(w) > 400, F.lit(False)))
    return far.withColumn("past", F.bool_or("far").over(w)).where("not past").select("l_orderkey", "y")


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_partkey AS y FROM lineitem), g AS (SELECT *, LEAD(y) OVER (PARTITION BY l_orderkey ORDER BY y) AS nxt FROM r)
SELECT l_orderkey, y AS from_y, nxt - y AS height FROM g WHERE nxt - y >= 300""")
def segments_from_edges(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("y")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("y")).distinct()
    return rows.withColumn("height", F.lead("y").over(w) - F.col("y")).where("height >= 300").select("l_orderkey", F.col("y").alias("from_y"), "height")


# Shaping.


@query(f"WITH {OBS} SELECT log_id, signal, col, pos, CASE WHEN k % 2 = 0 THEN 'digit' ELSE 'label' END AS tag, CASE WHEN k % 2 = 0 THEN k END AS digit FROM obs")
def proj_typed_payload(spark, sf_dir):
    from chronolane.model import typed_payload

    even = F.col("k") % 2 == 0
    wire = F.to_json(F.struct(F.when(even, "digit").otherwise("label").alias("type"), F.col("k").alias("digit")))
    rows = observations(spark, sf_dir).withColumn("value", wire).withColumn("tag", F.get_json_object("value", "$.type"))
    digit = F.get_json_object(typed_payload(F.when(F.col("tag") == "digit", F.col("value")), "arm"), "$.digit").cast("long")
    return rows.select("log_id", "signal", "col", "pos", "tag", digit.alias("digit"))


@query(f"WITH {OBS} SELECT log_id, col, pos, ROW_NUMBER() OVER (PARTITION BY log_id, col ORDER BY t_us, pos) AS n, v FROM obs WHERE signal = 'purchase'")
def filter_series(spark, sf_dir):
    rows = observations(spark, sf_dir).where("signal = 'purchase'")
    return rows.select("log_id", "col", "pos", F.row_number().over(temporal.ordered("log_id", "col")).alias("n"), "v")


#: Order of the signals: level of the dependency graph, then name.
LEVELS = {"view": 0, "click": 1, "signup": 1, "error": 2, "purchase": 2}
_level = "CASE signal " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in LEVELS.items()) + " END"


@query(f"WITH {OBS} SELECT log_id, frame, pos, ROW_NUMBER() OVER (PARTITION BY log_id, frame ORDER BY {_level}, signal, col, pos) AS place FROM (SELECT * REPLACE (t_us // {24 * HOUR} AS frame) FROM obs)")
def emit_order(spark, sf_dir):
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("signal")]
    w = Window.partitionBy("log_id", "frame").orderBy(level, "signal", "col", "pos")
    rows = observations(spark, sf_dir).withColumn("frame", F.floor(F.col("t_us") / (24 * HOUR)))
    return rows.select("log_id", "frame", "pos", F.row_number().over(w).alias("place"))


#: Readings with a wide and a narrow score: matched updates, text without a match holds (no row), no text clears.
@query(f"""WITH {OBS}, r AS (SELECT log_id, col, pos, k % 10 AS wide, k // 10 AS narrow FROM obs WHERE signal = 'signup')
SELECT log_id, col, pos, CASE WHEN GREATEST(wide, narrow) >= 7 THEN CASE WHEN narrow >= wide THEN 'narrow' ELSE 'wide' END END AS v FROM r WHERE GREATEST(wide, narrow) >= 7 OR (wide = 0 AND narrow = 0) OR GREATEST(wide, narrow) < 3""")
def tristate_resolution(spark, sf_dir):
    rows = observations(spark, sf_dir).where("signal = 'signup'").withColumn("wide", F.col("k") % 10).withColumn("narrow", F.floor(F.col("k") / 10))
    best = F.greatest("wide", "narrow")
    decision = F.when(best >= 7, F.struct(F.when(F.col("narrow") >= F.col("wide"), "narrow").otherwise("wide").alias("v"))).when(best < 3, F.struct(F.lit(None).cast("string").alias("v")))
    return rows.withColumn("d", decision).where("d is not null").select("log_id", "col", "pos", "d.v")


MESSAGES = "m AS (SELECT conv_id, turn, w.x AS text, w.i AS ord FROM (SELECT conv_id, turn, UNNEST(list_transform(string_split(replace(text, chr(10), ' '), ' '), lambda x, i: {'x': x, 'i': i})) AS w FROM conversations))"


def messages(spark, sf_dir):
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words).alias("ord", "text")).withColumn("ord", F.col("ord") + 1)


@query(f"WITH {MESSAGES} SELECT conv_id, turn, text, MIN(ord) AS ord FROM m GROUP BY conv_id, turn, text")
def explode_popups(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("conv_id", "turn", "text").agg(F.min("ord").alias("ord"))


@query(f"WITH {MESSAGES} SELECT conv_id, turn, length(text) AS arm, arg_max(text, ord) AS status FROM m WHERE length(text) > 0 GROUP BY conv_id, turn, length(text)")
def explode_last_wins(spark, sf_dir):
    return messages(spark, sf_dir).where(F.length("text") > 0).groupBy("conv_id", "turn", F.length("text").alias("arm")).agg(F.max_by("text", "ord").alias("status"))


@query(f"WITH {MESSAGES} SELECT conv_id, turn, ord, text FROM m WHERE length(text) >= 6")
def explode_filtered_array(spark, sf_dir):
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    placed = F.transform(words, lambda w, i: F.struct((i + 1).alias("ord"), w.alias("text")))
    long = F.filter(placed, lambda p: F.length(p["text"]) >= 6)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(long).alias("p")).select("conv_id", "turn", "p.ord", "p.text")


@query(f"""WITH {OBS}, {STATE}, {LANE_RUNS}, n AS (SELECT log_id, COUNT(*) AS intervals, CAST(SUM(end_us - start_us) FILTER (lane = 'no_ui') AS BIGINT) AS no_ui_us FROM lane_runs GROUP BY log_id), d AS (SELECT log_id, COUNT(*) AS observations FROM obs GROUP BY log_id)
SELECT 'log-' || log_id AS name, observations, intervals, COALESCE(no_ui_us, 0) AS no_ui_us FROM d JOIN n USING (log_id)""")
def listing_row(spark, sf_dir):
    obs = observations(spark, sf_dir)
    totals = summary.totals(lane_runs(spark, sf_dir, obs), {"no_ui": "no_ui"})
    foot = summary.footer(obs, "view")
    return foot.join(totals, "log_id").select(F.concat(F.lit("log-"), F.col("log_id").cast("string")).alias("name"), "observations", "intervals", "no_ui_us")
