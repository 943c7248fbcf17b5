"""Queries on dimensions, fuzzy matching and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolane.functions import text
from chronolane.operators import catalog, privacy, temporal

from .bind import OBS, common_sql, observations, partial_sql, query, table

#: Entries made from parts: the name, a localized name for every third, reload colors for every fifth.
COLORS = {"red": "rot", "blue": "blau"}
ENTRIES = """e AS (SELECT p_partkey AS entry_id, p_name || ' ' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'TEIL ' || p_partkey END AS localized,
  CASE WHEN p_partkey % 5 = 0 THEN ['red', 'blue'] ELSE [] END AS colors FROM part),
a AS (SELECT entry_id, name AS alias, 'name' AS kind FROM e UNION ALL SELECT entry_id, localized, 'localized' FROM e WHERE localized IS NOT NULL
  UNION ALL SELECT entry_id, name || ' [' || CASE c WHEN 'red' THEN 'rot' ELSE 'blau' END || ']', 'reload' FROM (SELECT entry_id, name, UNNEST(colors) AS c FROM e))"""


def entries(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("entry_id"),
        F.concat_ws(" ", "p_name", key).alias("name"),
        F.when(key % 3 == 0, F.concat(F.lit("TEIL "), key.cast("string"))).alias("localized"),
        F.when(key % 5 == 0, F.array(F.lit("red"), F.lit("blue"))).otherwise(F.array().cast("array<string>")).alias("reload_colors"),
        "p_size",
        "p_type",
        "p_brand",
    )


@query(f"WITH {ENTRIES} SELECT entry_id, alias, kind FROM a")
def catalog_expand_aliases(spark, sf_dir):
    return catalog.expand_aliases(entries(spark, sf_dir), COLORS)


@query("SELECT lower(p_brand) AS alias, COUNT(DISTINCT p_partkey) AS owners FROM part GROUP BY lower(p_brand) HAVING COUNT(DISTINCT p_partkey) > 1")
def catalog_conflicts(spark, sf_dir):
    return catalog.conflicts(entries(spark, sf_dir).select("entry_id", F.col("p_brand").alias("alias")))


@query(f"""WITH {OBS}, {ENTRIES}, q AS (SELECT pos, 'teil ' || k AS text FROM obs WHERE signal = 'click')
SELECT pos, text, entry_id FROM q LEFT JOIN (SELECT lower(alias) AS f, MIN(entry_id) AS entry_id FROM a GROUP BY 1) ON f = text""")
def catalog_resolve(spark, sf_dir):
    asked = observations(spark, sf_dir).where("signal = 'click'").select("pos", F.concat(F.lit("teil "), F.col("k").cast("string")).alias("text"))
    return catalog.resolve(asked, "text", catalog.expand_aliases(entries(spark, sf_dir), COLORS))


@query("""SELECT p_partkey, p_type AS kind, p_size > 25 AS is_system, CASE WHEN p_size % 5 = 0 THEN '?' WHEN p_size % 5 = 1 THEN '-' WHEN p_size % 5 = 2 THEN 'idle' ELSE 'idle->cut/seal' END AS cell,
ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_size > 25, p_type, p_name, p_partkey) AS place FROM part""")
def catalog_listing(spark, sf_dir):
    n = F.col("p_size") % 5
    labels = F.when(n == 0, None).when(n == 1, F.array().cast("array<string>")).when(n == 2, F.array(F.lit("idle"))).otherwise(F.array(*map(F.lit, ("idle", "cut", "seal"))))
    cell = (
        F.when(F.col("labels").isNull(), "?")
        .when(F.size("labels") == 0, "-")
        .when(F.size("labels") == 1, F.get("labels", F.lit(0)))
        .otherwise(F.concat(F.get("labels", F.lit(0)), F.lit("->"), F.array_join(F.slice("labels", 2, 9), "/")))
    )
    w = Window.partitionBy("p_brand").orderBy(F.col("p_size") > 25, "p_type", "p_name", "p_partkey")
    return table(spark, sf_dir, "part").withColumn("labels", labels).select("p_partkey", F.col("p_type").alias("kind"), (F.col("p_size") > 25).alias("is_system"), cell.alias("cell"), F.row_number().over(w).alias("place"))


@query(f"WITH {OBS} SELECT pos, COALESCE(p_type, 'unknown') AS type FROM obs LEFT JOIN part ON p_partkey = k * 30")
def left_join_default(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_type")
    rows = observations(spark, sf_dir).select("pos", (F.col("k") * 30).alias("key"))
    return rows.join(part, "key", "left").select("pos", F.coalesce("p_type", F.lit("unknown")).alias("type"))


@query(f"""WITH {OBS}, c AS (SELECT * FROM obs WHERE signal = 'purchase' AND v IS NOT NULL), i AS (SELECT * FROM obs WHERE signal = 'signup'), l AS (SELECT * FROM obs WHERE signal = 'view'),
x AS (SELECT c.log_id, c.pos, c.col, c.t_us, CASE WHEN i.v IS NOT NULL THEN i.k END AS inst FROM c ASOF LEFT JOIN i ON c.log_id = i.log_id AND c.col = i.col AND c.t_us >= i.t_us),
y AS (SELECT x.*, CASE WHEN l.v IS NOT NULL THEN l.k END AS label FROM x ASOF LEFT JOIN l ON x.log_id = l.log_id AND x.col = l.col AND x.t_us >= l.t_us)
SELECT log_id, pos, CASE p_size % 4 WHEN 1 THEN 'only' WHEN 2 THEN CASE WHEN label % 2 = 0 THEN 'cut' WHEN label % 2 = 1 THEN 'seal' END END AS action FROM y LEFT JOIN part ON p_partkey = inst""")
def pedal_action_lookup(spark, sf_dir):
    obs = observations(spark, sf_dir)
    press = obs.where("signal = 'purchase' and v is not null")
    inst = temporal.asof(press, obs.where("signal = 'signup'"), ["log_id", "col"], ["k", "v"])
    inst = inst.withColumn("inst", F.when(F.col("got.v").isNotNull(), F.col("got.k"))).drop("got")
    both = temporal.asof(inst, obs.where("signal = 'view'"), ["log_id", "col"], ["k", "v"])
    both = both.withColumn("label", F.when(F.col("got.v").isNotNull(), F.when(F.col("got.k") % 2 == 0, "cut").otherwise("seal")))
    n = F.col("p_size") % 4
    labels = F.when(n == 1, F.array(F.lit("only"))).when(n == 2, F.array(F.lit("cut"), F.lit("seal"))).when(n == 3, F.array().cast("array<string>"))
    dim = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("inst"), labels.alias("labels"))
    # Labels are read exactly here, so the held label is always close enough.
    return both.join(dim, "inst", "left").select("log_id", "pos", catalog.action(F.col("labels"), F.col("label"), F.lit(100.0)).alias("action"))


#: Scores of entries for texts: how alike an item's key and a part's key are, a stand-in that SQL can repeat.
@query("""WITH s AS (SELECT item_id, p_partkey AS entry_id, 100 - abs(length(text) % 97 - p_partkey % 101) AS score FROM benchmark, part),
r AS (SELECT *, ROW_NUMBER() OVER w AS n, score - LEAD(score) OVER w AS margin FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, entry_id)) SELECT item_id, entry_id, score, margin FROM r WHERE n = 1""")
def topk_margin(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", (F.length("text") % 97).alias("x"))
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), (F.col("p_partkey") % 101).alias("r"))
    # A score follows from two remainders, so the two smallest entries of each remainder stand for all, and items of one remainder have one answer.
    first = entries.groupBy("r").agg(F.min("entry_id").alias("least"))
    second = entries.join(first, "r").where(F.col("entry_id") > F.col("least")).groupBy("r").agg(F.min("entry_id").alias("entry_id"))
    two = first.select("r", F.col("least").alias("entry_id")).unionByName(second)
    asked = items.select("x").distinct().withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long"))))
    scored = asked.join(two, "r").select("x", "entry_id", (100 - F.abs(F.col("x") - F.col("r"))).alias("score"))
    return items.join(catalog.top_and_margin(scored, ["x"]), "x").select("item_id", "entry_id", "score", "margin")


@query(f"""WITH RECURSIVE names AS (SELECT p_name AS name, MIN(p_partkey) AS entry_id FROM part GROUP BY p_name),
asked AS (SELECT entry_id AS asked, replace(lower(trim(regexp_replace(substr(name, 1, 3) || ' x' || substr(name, 4), '\\s+', ' ', 'g'))), 'ß', 'ss') AS a FROM names),
pairs AS (SELECT asked, entry_id, a, replace(lower(name), 'ß', 'ss') AS b FROM asked, names), {common_sql("pairs")},
scored AS (SELECT asked, entry_id, 200.0::DOUBLE * common / (length(a) + length(b)) AS ratio, round_even(200.0::DOUBLE * common / (length(a) + length(b)), 0) AS score FROM pairs JOIN lcs USING (a, b)),
r AS (SELECT *, ROW_NUMBER() OVER w AS n, score - LEAD(score) OVER w AS margin FROM scored WHERE ratio >= 70 WINDOW w AS (PARTITION BY asked ORDER BY ratio DESC, entry_id))
SELECT asked, entry_id, score, margin FROM r WHERE n = 1""")
def fuzzy_catalog_match(spark, sf_dir):
    """Noisy part names against the distinct names, case folded: best entry of at least 70, whole scores, and its lead."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entry_id"))
    noisy = names.select(F.col("entry_id").alias("asked"), F.concat(F.substring("name", 1, 3), F.lit(" x"), F.expr("substring(name, 4)")).alias("text"))
    folded = noisy.select("asked", text.casefold(text.squeezed(F.col("text"))).alias("text"))
    best = catalog.match(folded, names.select("entry_id", text.casefold(F.col("name")).alias("alias")), 70)
    # The exact ratio ranks; whole scores are what is told.
    return best.select("asked", "entry_id", F.bround("score").alias("score"), (F.bround("score") - F.bround(F.col("score") - F.col("margin"))).alias("margin"))


TEMPLATES = [("bench", "sent by {name}: the erhe thatnd"), ("ring", "call {number} and then for the onen")]


@query(f"""WITH RECURSIVE forms(template_id, ord, x) AS (VALUES ('bench', 0, ': the erhe thatnd'), ('ring', 1, 'and then for the onen')),
turns AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS y FROM conversations),
pairs AS (SELECT x, y FROM forms, turns), {partial_sql("pairs")},
r AS (SELECT conv_id, turn, template_id, score, ROW_NUMBER() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, ord) AS n FROM turns JOIN part USING (y) JOIN forms USING (x) WHERE score >= 60)
SELECT conv_id, turn, template_id, ROUND(score, 4) AS score FROM r WHERE n = 1""")
def fuzzy_template_join(spark, sf_dir):
    """Whole texts of conversation turns against two templates."""
    forms = spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(TEMPLATES)], "template_id string, ord int, template string")
    tails = forms.select("template_id", "ord", F.trim(privacy.template_tail(F.col("template"))).alias("tail"))
    hit = privacy.best_template(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", tails, threshold=60)
    return hit.where("hit is not null").select("conv_id", "turn", "hit.template_id", F.round("hit.score", 4).alias("score"))


# Text.


@query("SELECT page_id, replace(lower(url), 'ß', 'ss') AS folded FROM pages UNION ALL SELECT doc_id + 1000000, replace(lower(text), 'ß', 'ss') FROM documents")
def str_casefold(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", text.casefold(F.col("url")).alias("folded"))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000000).alias("page_id"), text.casefold(F.col("text")).alias("folded"))
    return pages.unionAll(docs)


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM conversations""")
def str_normalize(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalized(F.col("text")).alias("plain"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS plain FROM documents")
def str_squeeze(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.squeezed(F.col("text")).alias("plain"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(strip_accents(replace(replace(lower(text), '-' || chr(10), ''), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g')) AS plain FROM conversations""")
def str_fold(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.folded("text").alias("plain"))


@query("""WITH w AS (SELECT CAST(greatest(9, MAX(length(CAST(c_custkey AS VARCHAR)))) AS INT) AS a, CAST(greatest(6, MAX(length(c_name))) AS INT) AS b, CAST(greatest(12, MAX(length(c_mktsegment))) AS INT) AS c FROM customer)
SELECT c_custkey, rtrim(rpad(CAST(c_custkey AS VARCHAR), a, ' ') || '  ' || rpad(c_name, b, ' ') || '  ' || rpad(c_mktsegment, c, ' ')) AS line FROM customer, w""")
def text_table(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return text.aligned(rows, rows.columns)[2].select("c_custkey", "line")


@query("SELECT p_partkey, list_aggregate(list_transform(string_split(replace(p_name || '_of the_' || p_type, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS title FROM part")
def str_titlecase(spark, sf_dir):
    name = F.concat(F.col("p_name"), F.lit("_of the_"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.titled(name).alias("title"))


@query(r"SELECT page_id, regexp_replace(url, '(\.html|/|#top)$', '') AS stem FROM pages")
def str_strip_suffix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"(\.html|/|#top)$", "").alias("stem"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN '' ELSE ' of ' || p_type END AS tail FROM part")
def template_tail(spark, sf_dir):
    n = F.col("p_size") % 4
    form = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat("p_name", F.lit(" {x}"))).otherwise(F.concat(F.lit("{a} to {b}"), F.lit(" of "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", privacy.template_tail(form).alias("tail"))


@query("""SELECT conv_id, turn, list_aggregate(list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) > 9 THEN 'masked:long' ELSE w END), 'string_agg', ' ') AS masked FROM conversations""")
def mask_array(spark, sf_dir):
    words = F.transform(F.split("text", " "), lambda w: privacy.mask(w, F.when(F.length(w) > 9, "long")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(words, " ").alias("masked"))


@query("""WITH w AS (SELECT conv_id, turn, split_part(text, ' ', 1) AS word FROM conversations), f AS (SELECT conv_id, word, MIN(turn) AS first FROM w GROUP BY conv_id, word)
SELECT conv_id, string_agg(word, '|' ORDER BY first, word) AS words FROM f GROUP BY conv_id""")
def distinct_first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring_index("text", " ", 1).alias("word"))
    first = rows.groupBy("conv_id", "word").agg(F.min("turn").alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "word"))), lambda x: x["word"])
    return first.groupBy("conv_id").agg(F.array_join(listed, "|").alias("words"))


@query(r"""WITH l AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, lower(trim(line)) AS line FROM l WHERE trim(line) <> '') SELECT doc_id, string_agg(line, ' ' ORDER BY i) AS joined, ROUND(AVG(length(line)), 6) AS mean_length FROM k GROUP BY doc_id""")
def agg_join_lines(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l")).where("size(l) > 0")
    total = F.aggregate("l", F.lit(0), lambda a, x: a + F.length(x))
    return rows.select("doc_id", F.array_join("l", " ").alias("joined"), F.round(total / F.size("l"), 6).alias("mean_length"))


@query("SELECT page_id, TRY_CAST(regexp_extract(url, '/([^/?#]*)$', 1) AS INT) AS n FROM pages")
def try_cast_null(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/([^/?#]*)$", 1).try_cast("int").alias("n"))
