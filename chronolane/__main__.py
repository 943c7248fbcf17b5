"""Command line over the named API: rows as JSON lines on standard output, or as a text table with ``--table``.

    python -m chronolane query LOGS --at 1:02:03 [--show state|fresh|lanes]
    python -m chronolane intervals|summary LOGS [--actions ACTIONS.json] [--templates TEMPLATES.json] [--raw]
    python -m chronolane frames|inventory LOGS
    python -m chronolane search LOGS 'instrument:scissors "a phrase"'
    python -m chronolane catalog ENTRIES.json
    python -m chronolane screen LOGS --templates TEMPLATES.json

Texts that match a template are masked in intervals and summaries where templates
are given. ``screen`` exits with 1 if it finds something.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolane import api
from chronolane.functions.clock import parsed
from chronolane.functions.text import aligned
from chronolane.operators import privacy

ACTIONS = "alias string, color string, labels array<string>"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chronolane")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("query", "intervals", "summary", "frames", "inventory", "search", "screen", "catalog"):
        own = commands.add_parser(name)
        own.add_argument("entries" if name == "catalog" else "logs")
        own.add_argument("--table", action="store_true", help="aligned columns instead of JSON lines")
        if name == "search":
            own.add_argument("words")
        if name == "query":
            own.add_argument("--at", help="h:mm:ss or seconds")
            own.add_argument("--show", choices=("state", "fresh", "lanes"), default="state")
            own.add_argument("--actions")
        if name in ("intervals", "summary"):
            own.add_argument("--actions")
            own.add_argument("--raw", action="store_true", help="without corrections")
        if name in ("intervals", "summary", "screen"):
            own.add_argument("--templates", required=name == "screen")
    return out


def _templates(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("template_id string, ord int, template string").json(path, multiLine=True)
    wrong = privacy.template_errors(rows).limit(1).collect()
    if wrong:
        raise SystemExit(f"template {wrong[0]['template_id']}: {wrong[0]['problem']}")
    return rows.select("template_id", "ord", F.trim(privacy.template_tail(F.col("template"))).alias("tail"))


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "catalog":
        entries = spark.read.json(args.entries, multiLine=True)
        return entries.orderBy(*[c for c in ("is_system", "type", "name") if c in entries.columns])
    if args.command == "inventory":
        return api.inventory(spark, args.logs).orderBy("name")
    if args.command == "search":
        return api.search(api.inventory(spark, args.logs), args.words, api.corpus()).orderBy("name")
    log = api.load(spark, args.logs)
    if args.command == "query":
        at = log.groupBy("log_id").agg(F.max("t_us").alias("at_us"))
        if args.at is not None:
            seconds = F.coalesce(parsed(F.lit(args.at)), F.raise_error(F.lit(f"no time: {args.at}")).cast("double"))
            at = at.withColumn("at_us", F.round(seconds * 1_000_000).cast("long"))
        if args.show == "lanes":
            known = spark.read.schema(ACTIONS).json(args.actions, multiLine=True) if args.actions else spark.createDataFrame([], ACTIONS)
            return api.lanes_at(log, at, known).orderBy("log_id", "lane", "arm", "col")
        return (api.state_at if args.show == "state" else api.fresh_at)(log, at).orderBy("log_id", "signal", "key")
    if args.command == "frames":
        return api.frame_view(log).orderBy("log_id", "t_us")
    if args.command == "screen":
        return api.screen(log, _templates(spark, args.templates)).orderBy("log_id", "start_us", "col")
    actions = spark.read.schema(ACTIONS).json(args.actions, multiLine=True) if args.actions else spark.createDataFrame([], ACTIONS)
    if not args.raw:
        log = api.corrected(log, actions)
    if args.templates:
        log = api.masked(log, _templates(spark, args.templates))
    view = api.interval_view if args.command == "intervals" else api.summary_view
    return view(log, actions).orderBy("log_id")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("chronolane").getOrCreate()
    found, rows = 0, run(spark, args)
    if args.table:
        flat = rows.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in rows.dtypes])
        head, rule, lines = aligned(flat, flat.columns)
        print(head, rule, sep="\n")
        printed = (r[0] for r in lines.select("line").toLocalIterator())
    else:
        printed = rows.toJSON().toLocalIterator()
    for row in printed:
        print(row)
        found += 1
    return int(args.command == "screen" and found > 0)


if __name__ == "__main__":
    sys.exit(main())
