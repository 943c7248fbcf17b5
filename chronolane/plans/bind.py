"""The driver's event table as observation logs.

log_id: user_id mod 10; col: the next digit mod 4, plus 1; value: the event's value
in hundredths, absent under 500 of them; frame and pos: the event's id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000

#: The same binding for the oracle.
OBS = """obs AS (
  SELECT user_id % 10 AS log_id, (user_id // 10) % 4 + 1 AS col, epoch_us(ts) AS t_us, event_id AS pos, event_id AS frame,
    event_type AS signal, CASE WHEN value >= 5 THEN CAST(ROUND(value * 100) AS BIGINT) END AS v,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ROUND(value * 100) AS BIGINT) AS score
  FROM events)"""

#: Half-way through each log.
MID = "mid AS (SELECT log_id, (MIN(t_us) + MAX(t_us)) // 2 AS at_us FROM obs GROUP BY log_id)"



def common_sql(pairs: str) -> str:
    """CTEs for the oracle: ``lcs`` (a, b, common) has the longest common subsequence of each pair of ``pairs`` (a, b), a of 1 to 62 characters, by bits over a."""
    return f"""ab AS (SELECT DISTINCT a, b FROM {pairs}),
masks AS (SELECT a, substr(a, p, 1) AS c, SUM(1::HUGEINT << (p - 1)) AS mask FROM (SELECT a, UNNEST(range(1, length(a) + 1)) AS p FROM (SELECT DISTINCT a FROM ab)) GROUP BY a, c),
steps(a, b, i, bits) AS (SELECT a, b, 0, (1::HUGEINT << length(a)) - 1 FROM ab UNION ALL
  SELECT s.a, s.b, i + 1, ((bits + (bits & COALESCE(mask, 0::HUGEINT))) | (bits - (bits & COALESCE(mask, 0::HUGEINT)))) & ((1::HUGEINT << length(s.a)) - 1)
  FROM steps s LEFT JOIN masks m ON m.a = s.a AND m.c = substr(s.b, i + 1, 1) WHERE i < length(s.b)),
lcs AS (SELECT a, b, length(a) - bit_count(bits) AS common FROM steps WHERE i = length(b))"""


def partial_sql(pairs: str) -> str:
    """CTEs for the oracle: ``part`` (x, y, score) has the partial ratio of each pair of ``pairs`` (x, y), the shorter of up to 62 characters."""
    return f"""xy AS (SELECT DISTINCT x, y FROM {pairs}),
sides AS (SELECT x, y, x AS a, y AS l FROM xy WHERE length(x) <= length(y) UNION ALL SELECT x, y, y, x FROM xy WHERE length(y) <= length(x)),
windows AS (SELECT x, y, a, substr(l, greatest(0, e - length(a)) + 1, least(e, length(l)) - greatest(0, e - length(a))) AS b FROM (SELECT *, UNNEST(range(1, length(l) + length(a))) AS e FROM sides WHERE a <> '' AND NOT contains(l, a))),
{common_sql("windows")},
part AS (SELECT x, y, CASE WHEN contains(x, y) AND y <> '' OR contains(y, x) AND x <> '' OR x = y THEN 100.0::DOUBLE ELSE COALESCE(best, 0.0) END AS score FROM xy
  LEFT JOIN (SELECT x, y, MAX(200.0::DOUBLE * common / (length(a) + length(b))) AS best FROM windows JOIN lcs USING (a, b) GROUP BY x, y) USING (x, y))"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL that has its rows."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("log_id"),
        (F.floor(F.col("user_id") / 10) % 4 + 1).alias("col"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("t_us"),
        F.col("event_id").alias("pos"),
        F.col("event_id").alias("frame"),
        F.col("event_type").alias("signal"),
        F.when(F.col("value") >= 5, cents).alias("v"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        cents.alias("score"),
    )


def middle(obs: DataFrame) -> DataFrame:
    return obs.groupBy("log_id").agg(F.floor((F.min("t_us") + F.max("t_us")) / 2).cast("long").alias("at_us"))
