"""Queries on archives, search, scalars, sets and files."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.functions import clock
from chronolane.operators import archive, graph, privacy, ranks
from chronolane.sources import jsonl, sealed, tails
from chronolane.sources.shared import folder

from .bind import OBS, observations, partial_sql, query, table

#: An archive's entries made from pages: name, and popup and banner texts from the page's host and title.
CORPUS = "e AS (SELECT page_id, url AS name, string_split(regexp_extract(html, '<title>(.*?)</title>', 1), ' ') AS popup, [regexp_extract(url, '//([^/]*)', 1)] AS banner FROM pages)"


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.col("url").alias("name"),
        F.split(F.regexp_extract("html", "<title>(.*?)</title>", 1), " ").alias("popup"),
        F.array(F.regexp_extract("url", "//([^/]*)", 1)).alias("banner"),
    )


def fields():
    return {"name": F.array("name"), "popup": F.col("popup"), "banner": F.col("banner")}


@query(f"WITH {CORPUS} SELECT page_id FROM e WHERE len(list_filter([name] || popup || banner, lambda x: contains(lower(x), 'en'))) > 0 AND len(list_filter([name] || popup || banner, lambda x: contains(lower(x), 'example.org'))) > 0")
def search_all_tokens(spark, sf_dir):
    return archive.search(corpus(spark, sf_dir), "EN example.org", fields(), fuzzy=False).select("page_id")


@query(f"WITH {CORPUS} SELECT page_id FROM e WHERE len(list_filter(banner, lambda x: contains(lower(x), 'blog.'))) > 0 AND contains(lower(name), '/de/')")
def search_field_token(spark, sf_dir):
    return archive.search(corpus(spark, sf_dir), 'banner:blog. name:"/DE/"', fields(), fuzzy=False).select("page_id")


@query(f"WITH {CORPUS} SELECT page_id FROM e WHERE len(list_filter(popup || banner, lambda x: contains(lower(x), 'tion'))) > 0")
def search_text_union(spark, sf_dir):
    return archive.search(corpus(spark, sf_dir), "text:tion", fields(), fuzzy=False).select("page_id")


@query(f"WITH RECURSIVE {CORPUS}, pairs AS (SELECT 'exampel.org' AS x, lower(banner[1]) AS y FROM e), {partial_sql('pairs')} SELECT page_id FROM e JOIN part ON y = lower(banner[1]) WHERE score >= 80")
def search_fuzzy(spark, sf_dir):
    """A misspelt host finds its pages."""
    return archive.search(corpus(spark, sf_dir), "banner:exampel.org", fields()).select("page_id")


#: Queries in all forms that a search takes, made of each page's host and id.
@query("""WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS id, regexp_extract(url, '//([^/]*)', 1) AS host FROM pages),
t AS (SELECT page_id, [{'f': 'name', 't': host}, {'f': NULL, 't': 'two ' || id}, {'f': NULL, 't': 'nope:' || id}, {'f': 'text', 't': id}, {'f': 'popup', 't': 'open end ' || id || ' '}] AS l FROM p),
u AS (SELECT page_id, UNNEST(l) AS x, UNNEST(range(5)) AS place FROM t) SELECT page_id, CAST(place AS INT) AS place, x.f AS field, x.t AS token FROM u""")
def search_tokens(spark, sf_dir):
    host, key = F.regexp_extract("url", "//([^/]*)", 1), F.col("page_id").cast("string")
    asked = F.concat(F.lit(" name:"), host, F.lit(' "two '), key, F.lit('" nope:'), key, F.lit(" Text: "), key, F.lit(' POPUP:"open end '), key, F.lit(' "" '))
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(archive.tokens(asked)).alias("place", "x"))
    return found.select("page_id", "place", "x.field", "x.token")


@query("""WITH c AS (SELECT o_custkey, COUNT(*) AS n, COUNT(*) FILTER (o_orderstatus = 'F') AS changes FROM orders GROUP BY o_custkey)
SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY COALESCE(n * 1000 + LEAST(changes, 999), -1) DESC, c_name DESC) AS place FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def listing_sort(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("changes"))
    rows = table(spark, sf_dir, "customer").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left")
    rank = F.coalesce(F.col("n") * 1000 + F.least("changes", F.lit(999)), F.lit(-1))
    placed = ranks.numbered(rows.select("c_custkey", "c_name", rank.alias("rank")), [F.desc("rank"), F.desc("c_name")])
    return placed.select("c_custkey", "place")


@query("SELECT p_name AS label, COUNT(*) AS n FROM part WHERE contains(lower(p_name), 'ri') GROUP BY p_name ORDER BY n DESC, label LIMIT 8")
def topk_suggest(spark, sf_dir):
    words = table(spark, sf_dir, "part").where(F.lower("p_name").contains("ri")).groupBy(F.col("p_name").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return words.orderBy(F.desc("n"), "label").limit(8)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'running' WHEN o_custkey % 7 = 0 THEN 'outdated' ELSE 'complete' END AS state FROM orders")
def inventory_state(spark, sf_dir):
    footer = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    version = F.when(F.col("o_custkey") % 7 != 0, 1).otherwise(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", archive.state(footer, version).alias("state"))


@query(f"""WITH {OBS} SELECT pos, CASE WHEN k % 9 = 0 THEN NULL WHEN k - 5 <= 0 THEN NULL ELSE LEAST(1.0, ROUND(CAST(score AS DOUBLE) / ((k - 5) * 101), 4)) END AS progress FROM obs""")
def inventory_progress(spark, sf_dir):
    torn = F.when(F.col("k") % 9 == 0, F.concat(F.lit('{"t": 1'), F.col("score").cast("string"))).otherwise(F.to_json(F.struct(F.col("score").alias("t"))))
    last = F.try_variant_get(F.try_parse_json(torn), "$.t", "double")
    return observations(spark, sf_dir).select("pos", archive.progress(last, (F.col("k") - 5) * 101).alias("progress"))


@query("""WITH c AS (SELECT o_custkey AS name, COUNT(*) AS n, 'cached' AS origin FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey)
SELECT * FROM c UNION ALL SELECT o_custkey, COUNT(*), 'derived' FROM orders WHERE o_custkey NOT IN (SELECT name FROM c) GROUP BY o_custkey""")
def cache_or_derive(spark, sf_dir):
    each = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    cached = each.where("name % 2 = 0 or name % 3 = 0").withColumn("version", F.when(F.col("name") % 3 == 0, 1).otherwise(0)).withColumn("origin", F.lit("cached"))
    return archive.cached_or_derived(cached, each.withColumn("origin", F.lit("derived")), "name", 1)


@query("""WITH f AS (SELECT 'part-' || p_partkey || '.mp4' AS name FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'part-' || p_partkey || '.mkv' FROM part WHERE p_size % 3 = 0)
SELECT p_partkey, COALESCE(a.name, b.name) AS found FROM part LEFT JOIN f a ON a.name = 'part-' || p_partkey || '.mp4' LEFT JOIN f b ON b.name = 'part-' || p_partkey || '.mkv'""")
def lookup_priority_coalesce(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("stem"))
    files = part.where("p_size % 2 = 0").select(F.concat("stem", F.lit(".mp4")).alias("name")).unionAll(part.where("p_size % 3 = 0").select(F.concat("stem", F.lit(".mkv"))))
    candidates = [F.concat("stem", F.lit(s)) for s in (".mp4", ".mkv", ".mov")]
    return archive.first_present(part, "p_partkey", candidates, files).select("p_partkey", "found")


@query(f"""WITH {OBS}, r AS (SELECT log_id, col, t_us, pos, k, score, ROW_NUMBER() OVER (PARTITION BY log_id, col ORDER BY t_us, pos) AS n FROM obs WHERE signal = 'error'),
h AS (SELECT *, n - ROW_NUMBER() OVER (PARTITION BY log_id, col ORDER BY n) AS isl FROM r WHERE k >= 40),
ep AS (SELECT log_id, col, MIN(t_us) AS first_us, MAX(t_us) AS last_us, COUNT(*) AS reads, MAX(score) AS score FROM h GROUP BY log_id, col, isl),
g AS (SELECT log_id, t_us FROM obs WHERE signal = 'view'), sp AS (SELECT log_id, (MAX(t_us) - MIN(t_us)) // (COUNT(*) - 1) AS spacing FROM g GROUP BY log_id),
b AS (SELECT ep.*, g.t_us AS bt FROM ep ASOF LEFT JOIN g ON ep.log_id = g.log_id AND ep.first_us > g.t_us),
a AS (SELECT b.*, g.t_us AS aft FROM b ASOF LEFT JOIN g ON b.log_id = g.log_id AND b.last_us < g.t_us)
SELECT log_id, col, COALESCE(bt, first_us) AS start_us, COALESCE(aft, last_us + spacing) AS end_us, reads, score FROM a LEFT JOIN sp USING (log_id)""")
def episodes_screen(spark, sf_dir):
    obs = observations(spark, sf_dir)
    reads = obs.where("signal = 'error'").select("log_id", "col", "t_us", "pos", F.when(F.col("k") >= 40, "secret").alias("hit_id"), "score")
    found = privacy.episodes(reads, ["log_id", "col"])
    return privacy.snapped(found, obs.where("signal = 'view'"), ["log_id"]).select("log_id", "col", "start_us", "end_us", "reads", "score")


# Scalars.


@query(f"WITH {OBS} SELECT pos, CAST((score // 360000) * 3600 + (score // 6000 % 60) * 60 + score % 6000 / 100.0 AS DOUBLE) AS seconds FROM obs")
def time_parse_clock(spark, sf_dir):
    s = F.col("score")
    written = F.format_string("%d:%02d:%02d.%02d", F.floor(s / 360000), F.floor(s / 6000) % 60, F.floor(s / 100) % 60, s % 100)
    return observations(spark, sf_dir).select("pos", clock.parsed(written).alias("seconds"))


@query(f"WITH {OBS}, m AS (SELECT pos, GREATEST(score * 10 - 1000, 0) AS ms FROM obs) SELECT pos, printf('%02d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) || printf('.%03d', ms % 1000) AS clock FROM m")
def time_format_clock(spark, sf_dir):
    return observations(spark, sf_dir).select("pos", clock.formatted((F.col("score") - 100) / 100.0, millis=True).alias("clock"))


@query(f"WITH {OBS}, s AS (SELECT pos, CAST(score AS DOUBLE) AS span FROM obs) SELECT pos, COALESCE(list_filter([1.0, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600]::DOUBLE[], lambda x: span / x >= 4 AND span / x <= 14)[1], span / 8) AS step FROM s")
def math_tick_interval(spark, sf_dir):
    return observations(spark, sf_dir).select("pos", clock.tick_step(F.col("score").cast("double")).alias("step"))


@query(f"WITH {OBS} SELECT log_id, CASE WHEN SUM(score) > 0 THEN ROUND(100.0 * SUM(score) FILTER (signal = 'error') / SUM(score), 4) END AS share FROM obs GROUP BY log_id")
def math_share(spark, sf_dir):
    s = F.sum("score")
    part = F.sum(F.when(F.col("signal") == "error", F.col("score")))
    return observations(spark, sf_dir).groupBy("log_id").agg(F.when(s > 0, F.round(F.lit(100.0) * part / s, 4)).alias("share"))


LINES = "o AS (SELECT l_orderkey, list({'q': l_quantity, 'f': l_returnflag} ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS lines FROM lineitem GROUP BY l_orderkey)"


def order_lines(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))


@query(f"WITH {LINES} SELECT l_orderkey, len(list_filter(lines, lambda x: x.q <= 5)) = 0 AS every, len(list_filter(lines, lambda x: x.f = 'R')) > 0 AS any_returned FROM o")
def hof_forall_exists(spark, sf_dir):
    rows = order_lines(spark, sf_dir)
    return rows.select("l_orderkey", F.forall("lines", lambda x: x["q"] > 5).alias("every"), F.exists("lines", lambda x: x["f"] == "R").alias("any_returned"))


@query(f"WITH {LINES} SELECT l_orderkey, CAST(len(lines) AS BIGINT) AS n, list_aggregate(list_transform(lines, lambda x: x.f), 'string_agg', '') AS flags FROM o")
def hof_transform_size(spark, sf_dir):
    return order_lines(spark, sf_dir).select("l_orderkey", F.size("lines").cast("long").alias("n"), F.array_join(F.transform("lines", lambda x: x["f"]), "").alias("flags"))


@query(f"WITH {LINES} SELECT l_orderkey, list_aggregate(list_transform(lines[1:3], lambda x: x.f), 'string_agg', ',') || CASE WHEN len(lines) > 3 THEN ' +' || (len(lines) - 3) ELSE '' END AS shown FROM o")
def array_slice_rest(spark, sf_dir):
    rest = F.when(F.size("lines") > 3, F.concat(F.lit(" +"), (F.size("lines") - 3).cast("string"))).otherwise("")
    head = F.array_join(F.transform(F.slice("lines", 1, 3), lambda x: x["f"]), ",")
    return order_lines(spark, sf_dir).select("l_orderkey", F.concat(head, rest).alias("shown"))


@query("SELECT p_partkey, CASE regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z]+', '_', 'g') WHEN 'brand_economy' THEN 'green' WHEN 'brand_small' THEN 'blue' ELSE 'grey' END AS color FROM part")
def map_lookup_default(spark, sf_dir):
    colors = F.create_map(*map(F.lit, ("brand_economy", "green", "brand_small", "blue")))
    key = F.regexp_replace(F.lower(F.concat_ws(" ", "p_brand", "p_type")), "[^a-z]+", "_")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.try_element_at(colors, key), F.lit("grey")).alias("color"))


@query(f"WITH {OBS} SELECT pos, signal, v, score FROM obs")
def json_roundtrip(spark, sf_dir):
    wire = F.to_json(F.struct("signal", "v", "score"), {"ignoreNullFields": "false"})
    back = F.from_json(wire, "signal string, v bigint, score bigint")
    return observations(spark, sf_dir).select("pos", back.alias("b")).select("pos", "b.*")


@query(f"WITH {OBS} SELECT pos, CASE WHEN k % 3 = 1 THEN score END AS total FROM obs")
def json_versioned_decode(spark, sf_dir):
    wire = F.to_json(F.struct((F.col("k") % 3).alias("version"), F.col("score").alias("total")))
    parsed = F.from_json(wire, "version bigint, total bigint")
    return observations(spark, sf_dir).select("pos", F.when(parsed["version"] == 1, parsed["total"]).alias("total"))


# Sets and graphs.


@query("SELECT n_nationkey, n_name, list_contains(list_concat(['NATION_' || n_regionkey], ['NATION_1', 'NATION_2']), n_name) AND n_name <> 'NATION_2' AS picked FROM nation")
def sel_token_setalgebra(spark, sf_dir):
    group = F.array(F.concat(F.lit("NATION_"), F.col("n_regionkey").cast("string")))
    chosen = F.array_except(F.array_union(group, F.array(F.lit("NATION_1"), F.lit("NATION_2"))), F.array(F.lit("NATION_2")))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.array_contains(chosen, F.col("n_name")).alias("picked"))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("nation"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return a.subtract(b)


#: What depends on what in the given tables: orders on customers, those and suppliers on nations, these on regions.
_edges = """e(node, needs) AS (SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def dependencies(spark, sf_dir):
    def edge(name, own, other, needs):
        return table(spark, sf_dir, name).select(F.concat(F.lit(own[0]), F.col(own[1]).cast("string")).alias("node"), F.concat(F.lit(other), F.col(needs).cast("string")).alias("needs"))

    parts = [("orders", ("o", "o_orderkey"), "c", "o_custkey"), ("customer", ("c", "c_custkey"), "n", "c_nationkey"), ("supplier", ("s", "s_suppkey"), "n", "s_nationkey"), ("nation", ("n", "n_nationkey"), "r", "n_regionkey")]
    return reduce(DataFrame.unionByName, [edge(*part) for part in parts])


@query(f"""WITH RECURSIVE {_edges}, r(node, needs) AS (SELECT * FROM e UNION SELECT r.node, e.needs FROM r JOIN e ON r.needs = e.node) SELECT node, needs FROM r""")
def graph_closure(spark, sf_dir):
    return graph.closure(dependencies(spark, sf_dir))


@query(f"""WITH RECURSIVE {_edges}, n(node) AS (SELECT node FROM e UNION SELECT needs FROM e), d(node, level) AS (SELECT node, 0 FROM n UNION ALL SELECT e.node, d.level + 1 FROM d JOIN e ON e.needs = d.node)
SELECT node, MAX(level) AS level FROM d GROUP BY node""")
def graph_levels(spark, sf_dir):
    edges = dependencies(spark, sf_dir)
    return graph.levels(edges.select("node").union(edges.select("needs")), edges)


# Files.


def _folder(spark) -> str:
    return f"{folder(spark)}/chronolane-logs-{uuid.uuid4().hex}"


def _wire(spark, sf_dir):
    """The bound logs as observations of the wire format."""
    names = F.create_map(*map(F.lit, ("view", "layout", "click", "arm", "signup", "instrument", "purchase", "pedals", "error", "popups")))
    return observations(spark, sf_dir).select(
        F.concat(F.lit("log-"), F.col("log_id").cast("string")).alias("log_id"),
        "pos",
        "t_us",
        "frame",
        names[F.col("signal")].alias("signal"),
        F.array(F.col("col").cast("string")).alias("key"),
        F.col("v").cast("string").alias("value"),
        (F.col("score") / 50000).alias("score"),
    )


@query(f"""WITH {OBS} SELECT 'log-' || log_id AS log_id, ROW_NUMBER() OVER (PARTITION BY log_id ORDER BY pos) AS pos, t_us, frame,
CASE signal WHEN 'view' THEN 'layout' WHEN 'click' THEN 'arm' WHEN 'signup' THEN 'instrument' WHEN 'purchase' THEN 'pedals' ELSE 'popups' END AS signal, CAST(v AS VARCHAR) AS value FROM obs""")
def src_jsonl_roundtrip(spark, sf_dir):
    where = _folder(spark)
    jsonl.write_logs(_wire(spark, sf_dir), where)
    back = jsonl.observations(jsonl.read_lines(spark, where))
    return back.select(F.regexp_extract("log_id", r"log_id=([^/]*)/", 1).alias("log_id"), "pos", "t_us", "frame", "signal", "value")


@query(f"""WITH {OBS}, n AS (SELECT log_id, COUNT(*) AS n, MAX(t_us) AS t, arg_max(frame, pos) AS frame FROM obs GROUP BY log_id)
SELECT 'log-' || log_id AS log_id, '{{"log_version":1}}' AS first, frame AS second_last_frame, n AS observations FROM n""")
def src_edge_lines(spark, sf_dir):
    where = _folder(spark)
    jsonl.write_logs(_wire(spark, sf_dir), where)
    edges = jsonl.read_edges(spark, where)
    return edges.select(
        F.regexp_extract("file", r"log_id=([^/]*)/", 1).alias("log_id"),
        "first",
        F.get_json_object("second_last", "$.f").cast("long").alias("second_last_frame"),
        F.get_json_object("last", "$.observations").cast("long").alias("observations"),
    )


@query(f"WITH {OBS} SELECT DISTINCT 'log-' || log_id AS log_id, log_id >= 7 AS fresh FROM obs")
def src_incremental_scan(spark, sf_dir):
    where = _folder(spark)
    jsonl.write_logs(_wire(spark, sf_dir), where)
    name = F.regexp_extract("name", r"log_id=([^/]*)/", 1)
    now = tails.listing(spark, where).where(name != "")
    known = now.where(name < "log-7").withColumn("fresh", F.lit(False))
    fresh = jsonl.changed(now, known).withColumn("fresh", F.lit(True))
    return jsonl.refreshed(now, known, fresh).select(name.alias("log_id"), "fresh")


@query(f"""WITH {OBS} SELECT 'log-' || log_id AS log_id, COUNT(*) AS observations, MAX(t_us) AS last_us, 'kept' AS note, 'complete' AS state FROM obs GROUP BY log_id""")
def src_sealed_tails(spark, sf_dir):
    """Header, appendix and footer of logs that the library sealed, from head and tail of each file."""
    where = _folder(spark)
    obs = _wire(spark, sf_dir)
    logs = obs.select("log_id").distinct()
    appendix = logs.select("log_id", F.lit(sealed.APPENDIX).alias("step"), F.lit('{"intervals_version":1,"intervals":[],"note":"kept"}').alias("line"))
    footer = logs.select("log_id", F.lit(sealed.FOOTER).alias("step"), F.lit('{"summary_version":1,"summary":{}}').alias("line"))
    jsonl.write_logs(obs, where, appendix.unionByName(footer))
    read = tails.edge_lines(tails.listing(spark, where)).withColumn("footer", jsonl.footer(F.col("last")))
    return read.select(
        F.regexp_extract("name", r"log_id=([^/]*)/", 1).alias("log_id"),
        "footer.observations",
        F.get_json_object("last", "$.last_us").cast("long").alias("last_us"),
        F.get_json_object("second_last", "$.note").alias("note"),
        archive.state(F.col("footer.observations"), F.col("footer.summary_version")).alias("state"),
    )
