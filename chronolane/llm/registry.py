"""The queries of this subpackage, with production parameters, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    centroids,
    decontaminate,
    hilbert_shards,
    html_extract,
    licenses,
    media,
    mixing,
    repair,
    simhash_dedup,
    suffix_dedup,
    toxicity,
    url_filter,
)
from .common import DOC_ID, TEXT, small_batches, table


def vocabulary() -> tuple[str, str, str]:
    import public_tokenizers

    path = public_tokenizers.path
    return str(path("byte_bpe_50k.json")), str(path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    words = vocabulary()
    ids = bpe.encode(table(spark, sf_dir, "documents"), words)
    return bpe.decode(ids, words).select(
        DOC_ID,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(TEXT).cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(
        F.col(DOC_ID).alias("file_id"),
        F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col(DOC_ID)).alias("path"),
        TEXT,
    )
    return licenses.scan(files, licenses.templates(spark)).withColumnRenamed("file_id", DOC_ID)


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cleaned = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    sizes = F.transform("spans", lambda x: x["e"] - x["s"])
    return cleaned.select(
        DOC_ID,
        "n_bytes",
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # What stays, to be read: bytes of characters of which a part went read as replacement characters.
        F.expr("make_valid_utf8(cast(kept as string))").alias("text"),
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_extract.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards.shards(table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select(
        DOC_ID, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell"
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The rules that go before the mined ones: verdict, host, path.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").groupBy(DOC_ID).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    # The number that ends a page's path is the id of the document it was made from, which is what labels are about.
    about = pages.select("url", F.regexp_extract(url_filter.host_and_path(F.col("url"))[1], r"/(\d{1,18})(?:\D[^/]*)?/?\z", 1).try_cast("long").alias(DOC_ID))
    return url_filter.judge(pages, about.join(labels, DOC_ID).select("url", "blocked"), URL_RULES)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    back = media.read(media.store(table(spark, sf_dir, "documents")))
    clips = F.transform("clips", lambda c: F.format_string("%.2f-%.2f", c["start_s"], c["end_s"]))
    return back.select(
        DOC_ID,
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("clips="), F.array_join(clips, ",")).alias("feature"),
    )


def held_out(doc_id: str = DOC_ID) -> Column:
    """A fifth of the ids, which no model may learn from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, model).select(
        DOC_ID,
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["end_word"] - x["first_word"])
    return mixing.placed(table(spark, sf_dir, "documents")).select(
        DOC_ID, "size", "source_size", "target", pieces.alias("taken"), F.size("pieces").cast("long").alias("n_pieces")
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, seed=3)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_simhash": op2_simhash,
        "op3_licenses": op3_licenses,
        "op4_suffix_array": op4_suffix_array,
        "op5_html": op5_html,
        "op6_hilbert_shards": op6_hilbert_shards,
        "op7_decontamination": op7_decontamination,
        "op8_url_filter": op8_url_filter,
        "op9_toxicity": op9_toxicity,
        "op10_media": op10_media,
        "op11_mixing": op11_mixing,
        "op12_centroids": op12_centroids,
        "op13_repair": op13_repair,
    }


_rules = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in URL_RULES)
#: Hosts, paths and fixed rules. Rules that FP-growth mines are not in it: in the given tables no token combination reaches their lift.
OP8_SQL = f"""WITH r(verdict, h, p) AS (VALUES {_rules}),
u AS (SELECT page_id, CASE WHEN strpos(COALESCE(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, host, path, (SELECT arg_max({{'rule': h || p, 'verdict': verdict}}, length(h || p)) FROM r WHERE host <> '' AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS fit FROM s)
SELECT page_id, host, path, fit.rule AS rule, COALESCE(fit.verdict, 'allow') AS verdict, CAST(0 AS BIGINT) AS n_rules FROM f"""



def _centroid_sql(rounds: int) -> str:
    """One CTE for each round; components are rows (vec_id, i, v)."""
    steps = []
    for r in range(rounds + 1):
        # The sums of products in wide integers, each vector with each centroid; of equally near ones the first.
        steps.append(
            f"""d{r} AS MATERIALIZED (SELECT vec_id, k, CAST(SUM((v.v - c.v) * (v.v - c.v)) AS BIGINT) AS d FROM v JOIN c{r} c USING (i) GROUP BY vec_id, k),
a{r} AS MATERIALIZED (SELECT vec_id, MIN(d) AS distance, arg_min(k, (d, k)) AS cluster FROM d{r} GROUP BY vec_id)"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT cluster AS k, i, CAST(SUM(v) AS BIGINT) AS s, COUNT(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (SELECT k, i, CASE WHEN n IS NULL THEN c.v WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS v FROM c{r} c LEFT JOIN s{r} USING (k, i))"""
            )
    return ",\n".join(steps)


#: Round by round; vec_ids are unique in the given tables, as the SQL takes them to be.
OP12_SQL = f"""WITH e AS MATERIALIZED (SELECT vec_id, embedding AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM (SELECT vec_id, UNNEST(x) AS x, UNNEST(range(64)) AS i FROM e)),
f AS (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM e),
c0 AS MATERIALIZED (SELECT CAST(k AS INT) AS k, i, v FROM f JOIN v USING (vec_id) WHERE k < 8),
{_centroid_sql(10)},
h AS (SELECT k AS cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c10 GROUP BY k)
SELECT vec_id, cluster, distance, CAST(SUM(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(SUM(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a10 JOIN h USING (cluster)"""


def _repair_sql() -> str:
    """Cost, audit and lines of the four states, turn by turn, in one recursive query; the least (cost, audit) of all ways into a state."""

    def way(state: str, edit: str, line: str, extra: str = "0") -> str:
        return f"{{'c': {state}.c + {repair.COST[edit]} + {extra}, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def named(role: str, text: str = "''") -> str:
        return f"chr(10) || '{role}:' || {text}"

    def kept(state: str, role: str) -> str:
        return f"CASE WHEN initial = '{role}' AND fault NOT IN ('b', 'd') THEN {way(state, 'K', "chr(10) || role || ':' || text", 'cut')} END"

    def renamed(state: str, role: str) -> str:
        return f"CASE WHEN fault NOT IN ('b', 'd') THEN {way(state, 'R', named(role, 'text'), 'cut')} END"

    def gone(state: str) -> str:
        return way(state, "D", "''")

    after = [
        least(gone("s0")),
        least(gone("s1"), kept("s0", "s")),
        least(gone("s2"), *[f(x, r) for x in ("s0", "s1", "s3") for f, r in ((kept, "u"), (renamed, "user"))]),
        least(gone("s3"), kept("s2", "a"), renamed("s2", "assistant")),
    ]
    user, assistant = named("user"), named("assistant")
    twice = [way(f"({way(q, 'I', user)})", "I", assistant) for q in ("q0", "q1")]
    then = ["q0", "q1", least("q2", *[way(q, "I", user) for q in ("q0", "q1", "q3")]), least("q3", way("q2", "I", assistant), *twice)]
    never = "{'c': 1000000000, 'a': '', 't': ''}"
    begin = ["{'c': 0, 'a': '', 't': ''}", never, f"{{'c': 2, 'a': 'I', 't': {user}}}", f"{{'c': 4, 'a': 'II', 't': {user} || {assistant}}}"]
    each = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda c, b: {each}), 4294967295) % 20 AS INT) AS h FROM k),
m AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, UNNEST(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, DENSE_RANK() OVER (ORDER BY conv_id NULLS FIRST) AS c, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS n FROM m),
b AS (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial, ROW_NUMBER() OVER (PARTITION BY c, role, text ORDER BY n) AS nth, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body FROM o),
f AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, LAG(initial) OVER (PARTITION BY c ORDER BY n) AS prior FROM b),
g AS MATERIALIZED (SELECT *, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cut FROM f),
w(c, n, s0, s1, s2, s3) AS (SELECT DISTINCT c, 0::BIGINT, {", ".join(begin)} FROM g UNION ALL
SELECT c, n, {", ".join(then)} FROM (SELECT g.c, g.n, {", ".join(f"{x} AS q{i}" for i, x in enumerate(after))} FROM w JOIN g ON g.c = w.c AND g.n = w.n + 1)),
l AS (SELECT c, {least("s0", "s3")} AS best FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c ORDER BY n DESC) AS z FROM w) WHERE z = 1),
t AS (SELECT c, conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 'b') AS blank, COUNT(*) FILTER (fault = 'd') AS duplicate, COUNT(*) FILTER (fault = 't') AS truncated,
COUNT(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY c, conv_id)
SELECT d.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, CAST(COALESCE(best.c, 0) AS BIGINT) AS cost, COALESCE(best.a, '') AS audit, sha256(COALESCE(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN l ON l.c = t.c"""


OP13_SQL = _repair_sql()


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": OP8_SQL, "op12_centroids": OP12_SQL, "op13_repair": OP13_SQL}
