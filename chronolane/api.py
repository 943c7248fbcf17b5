"""The engine by name: logs in, views out.

    from chronolane import api
    log = api.load(spark, "/logs")
    fixed = api.corrected(log, actions)
    api.interval_view(fixed, actions).show()

``actions``: (alias, color, labels) of the catalog. Results are lazy; only
``corrected`` writes the patches of each rule, a short list, before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolane.functions.text import normalized
from chronolane.model import INTERVALS_VERSION, LOG
from chronolane.operators import archive, lanes, privacy, rules, summary, temporal, wire
from chronolane.sources import jsonl, memories, tails
from chronolane.sources.shared import written

search = archive.search
INTERVAL = "lane string, arm int, col int, start_us long, end_us long, v string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The observations of all logs under ``path``; log_id is the file."""
    return wire.fields(jsonl.observations(jsonl.read_lines(spark, path)))


def state_at(log: DataFrame, at: DataFrame) -> DataFrame:
    return temporal.snapshot(log, at, wire.KEYS)


def fresh_at(log: DataFrame, at: DataFrame) -> DataFrame:
    return temporal.frame_at(log, at)


def lanes_at(log: DataFrame, at: DataFrame, actions: DataFrame) -> DataFrame:
    """(log_id, lane, arm, col, v): what the lanes of each log's last frame at or before its ``at_us`` show."""
    upto = log.join(at, LOG).where("t_us <= at_us").drop("at_us")
    grid, shown = wire.painted(upto, actions)
    last = grid.groupBy(LOG).agg(F.max("fo").alias("fo"))
    return shown.join(last, [LOG, "fo"]).select(LOG, "lane", "arm", "col", "v")


def corrected(log: DataFrame, actions: DataFrame, steps: list | None = None) -> DataFrame:
    """``log`` with the rules' patches applied, the default ones unless ``steps`` are given."""
    found = rules.correct(log, wire.default_rules(actions) if steps is None else steps, ["key"])
    return log if found is None else rules.corrected(log, written(found), ["key"])


def mask_patches(log: DataFrame, templates: DataFrame) -> DataFrame:
    """Point patches that set popup texts which match a template to ``masked:<id>``; ``templates``: (template_id, ord, tail).

    Take them from the log that the views will read, after the corrections.
    """
    stacks = log.where("signal = 'popups' and v is not null").select("*", F.posexplode(F.from_json("v", wire.SHAPES["popups"])["messages"]).alias("_at", "m"))
    hit = privacy.best_template(stacks.withColumn("_text", F.col("m.text")), "_text", templates)
    part = F.struct("_at", F.struct(privacy.mask(F.col("m.text"), F.col("hit.template_id")).alias("text"), F.col("m.box").alias("box")).alias("m"))
    # A row's messages are one payload, which was one value before.
    whole = hit.groupBy(LOG, "signal", "key", "t_us", "pos").agg(
        F.transform(F.array_sort(F.collect_list(part)), lambda x: x["m"]).alias("messages"), F.bool_or(F.col("hit").isNotNull()).alias("touched")
    )
    return whole.where("touched").select(
        LOG, "signal", "key", F.col("t_us").alias("start_us"), F.col("t_us").alias("end_us"), F.lit("set").alias("action"),
        F.to_json(F.struct(F.lit("popups").alias("type"), "messages")).alias("value"), F.col("pos").alias("patch_idx"), F.lit("mask").alias("by"),
    )


def masked(log: DataFrame, templates: DataFrame) -> DataFrame:
    """``log`` with the patches of ``mask_patches`` applied."""
    return rules.corrected(log, mask_patches(log, templates), ["key"])


def screen(log: DataFrame, templates: DataFrame) -> DataFrame:
    """(log_id, col, hit_id, start_us, end_us, reads, score): episodes of popups that match a template, snapped outwards to the layout's samples."""
    reads = log.where("signal = 'popups'").select(
        LOG, "col", "t_us", "pos", F.explode_outer(F.from_json("v", wire.SHAPES["popups"])["messages"]).alias("m")
    )
    hit = privacy.best_template(reads.withColumn("_text", F.coalesce(normalized(F.col("m.text")), F.lit(""))), "_text", templates)
    each = hit.groupBy(LOG, "col", "t_us", "pos", F.col("hit.template_id").alias("hit_id")).agg(F.max("hit.score").alias("score"))
    found = privacy.episodes(each, [LOG, "col"], read=["t_us", "pos"])
    return privacy.snapped(found, log.where("signal = 'layout'"), [LOG])


def frame_view(log: DataFrame) -> DataFrame:
    """One nested record a frame."""
    return lanes.frame_records(temporal.states(log, wire.KEYS), lambda h: F.array_join(h["key"], "/"))


def interval_view(log: DataFrame, actions: DataFrame) -> DataFrame:
    return wire.interval_view(log, actions)


def summary_view(log: DataFrame, actions: DataFrame) -> DataFrame:
    """One row a log: counts and durations of its lanes, mounts and mount changes."""
    runs = interval_view(log, actions).withColumn("col", F.col("arm"))
    names = {lane: lane for lane in ("pedal_yellow", "pedal_blue", "laser", "popup", "banner", "offscreen", "tool_association", "no_ui")}
    return summary.summarize(runs, names, "instrument")


def inventory(spark: SparkSession, path: str, by_content: bool = False) -> DataFrame:
    """(name, state, locale, header, footer, summary, progress): each log under ``path``.

    ``state``: running without a footer, complete with a current summary, outdated
    else; summary (JSON) of complete logs, progress of running ones with a known
    duration. Of each file three small ranges are read; ``by_content``: the whole
    file, for stores that only Spark opens. A file that is no log is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path) if by_content else tails.listing(spark, path)
    named = files.select(F.col("path").alias("name"), F.col("length").alias("size"), "content") if by_content else files
    return _entries(tails.edge_lines(named, by_content))


def _entries(edges: DataFrame) -> DataFrame:
    read = edges.withColumns({"header": jsonl.header(F.col("first")), "footer": jsonl.footer(F.col("last"))})
    kind = archive.state(F.col("footer.observations"), F.coalesce("footer.summary_version", F.lit(0)))
    last_s = F.get_json_object("last", "$.t").try_cast("double")
    return read.withColumn("state", kind).select(
        "name",
        "state",
        jsonl.locale(F.col("header")).alias("locale"),
        "header",
        "footer",
        F.when(F.col("state") == "complete", F.col("footer.summary")).alias("summary"),
        F.when(F.col("state") == "running", archive.progress(last_s, F.col("header.video.duration_s"))).alias("progress"),
    )


def remembered_inventory(spark: SparkSession, path: str, memory: str) -> DataFrame:
    """``inventory`` with modified and size, of which only new and changed files are opened.

    The rest is known from the last snapshot under ``memory``. What is gone from
    ``path`` goes. Each scan writes a snapshot of its own, which counts once it is
    whole, so scans may run at the same time.
    """
    now, known = tails.listing(spark, path), memories.newest(spark, memory)
    files = now if known is None else jsonl.changed(now, known)
    fresh = _entries(tails.edge_lines(files)).join(files, "name")
    return memories.kept(fresh if known is None else jsonl.refreshed(now, known, fresh.select(known.columns)), memory)


def intervals(spark: SparkSession, path: str, actions: DataFrame, memory: str) -> DataFrame:
    """(name, lane, arm, col, start_us, end_us, v) of all logs under ``path``, derived once.

    A log's own appendix counts if its version is current. For others, intervals
    that were derived from a file of the same name, time and size at this version
    are read from ``memory``; those of the rest are derived and stored there.
    """
    files = tails.listing(spark, path)
    lines = tails.edge_lines(files).select("name", jsonl.appendix(F.col("second_last"), INTERVALS_VERSION).alias("own"))
    told = written(lines.where("own is not null").select("name", F.explode_outer("own.intervals").alias("x")))
    rest = written(files.join(told, "name", "left_anti"))
    known = memories.newest(spark, memory)
    good = None if known is None else known.join(rest, ["name", "modified", "size"], "left_semi").where(F.col("version") == INTERVALS_VERSION)
    open_ = rest if good is None else rest.join(good, "name", "left_anti")
    names = [r["name"] for r in open_.select("name").collect()]  # paths, which Spark's reader takes on the driver
    if names:
        runs = wire.interval_view(wire.fields(jsonl.observations(jsonl.read_lines(spark, names))), actions)
        # A log without any interval has one row of nulls, so that it is known too.
        named = runs.withColumn("name", jsonl.path_of(F.col(LOG))).drop(LOG).select("name", F.struct("lane", "arm", "col", "start_us", "end_us", "v").alias("run"))
        made = open_.join(named, "name", "left").withColumn("version", F.lit(INTERVALS_VERSION))
        good = memories.kept(made if good is None else good.unionByName(made), memory)
    own = told.select("name", F.from_json("x", INTERVAL).alias("run"))
    return (own if good is None else own.unionByName(good.select("name", "run"))).where("run is not null").select("name", "run.*")


def corpus() -> dict:
    """What ``search`` looks into of an inventory's rows: names, and of summaries the instruments, actions and texts."""

    def listed(path: str, kind: str = "ARRAY<STRING>"):
        return F.coalesce(F.from_json(F.get_json_object("summary", path), kind), F.array().cast("array<string>"))

    uses = F.from_json(F.get_json_object("summary", "$.instruments"), "ARRAY<STRUCT<name: STRING, type: STRING>>")
    both = F.coalesce(F.flatten(F.transform(uses, lambda u: F.array(u["name"], u["type"]))), F.array().cast("array<string>"))
    actions = F.coalesce(F.map_keys(F.from_json(F.get_json_object("summary", "$.presses_by_action"), "MAP<STRING, STRING>")), F.array().cast("array<string>"))
    return {
        "name": F.array("name"),
        "instrument": F.filter(both, lambda x: x.isNotNull()),
        "action": actions,
        "popup": listed("$.popup_texts"),
        "banner": listed("$.banner_texts"),
    }
