"""Run-length intervals as gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.model import LOG, POS, TIME
from chronolane.sources.shared import written

from . import scan
from .temporal import last_sample_end, ordered


def closing_times(frames: DataFrame, width: int | None = None) -> DataFrame:
    """``frames`` with ``nxt``: the next frame's time; the last frame borrows the spacing before it."""
    return _closed(scan.along(frames, [LOG], ["fo"], width, _after=scan.following(TIME), _before=scan.previous(TIME)))


def own_frames(obs: DataFrame, width: int | None = None) -> DataFrame:
    """``obs`` with fo and nxt, for logs in which every row is a frame of its own: one window, no join."""
    return _closed(scan.along(obs, [LOG], [TIME, POS], width, fo=scan.ordinal(), _after=scan.following(TIME), _before=scan.previous(TIME)))


def _closed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("nxt", last_sample_end(F.col(TIME), F.col(f"_after.{TIME}"), F.col(f"_before.{TIME}"))).drop("_after", "_before")


def encode_runs(frames: DataFrame, painted: DataFrame, lane: list[str], width: int | None = None) -> DataFrame:
    """(log_id, lane, start_us, end_us, v): maximal runs of each lane over the frames of a log.

    ``frames``: (log_id, fo, t_us) with dense fo; ``painted``: (log_id, fo, lane, v),
    a row where the lane is shown. A missing frame closes a run; a change between
    two values splits it; a null v waits: the first value fills the run backwards,
    later nulls change nothing. Spans are half-open.
    """
    return encode_timed(painted.join(closing_times(frames, width).select(LOG, "fo", TIME, "nxt"), [LOG, "fo"]), lane, width)


def encode_timed(shown: DataFrame, lane: list[str], width: int | None = None) -> DataFrame:
    """The same for painted rows that carry fo, t_us and nxt."""
    if width is None:
        place = F.row_number().over(Window.partitionBy(LOG, *lane).orderBy("fo"))
        return _filled(_spans(shown, lane, F.col("fo").alias("_first"), (F.col("fo") - place).alias("_isl")), [LOG, *lane])
    return _encoded(shown.withColumns({"_first": F.col("fo"), "_prior": F.col("fo") - 1}), lane, width)


def encode_changes(changes: DataFrame, closes: DataFrame, lane: list[str], width: int | None = None) -> DataFrame:
    """The same from change points only: (log_id, lane, t_us, pos, shown, v), each holding until the lane's next one by (t_us, pos).

    ``closes``: (log_id, close_us), when a log's last runs end. The rows are as many
    as changes, not frames times lanes.
    """
    at = F.struct(TIME, POS)
    if width is None:
        w = Window.partitionBy(LOG, *lane).orderBy(TIME, POS)
        timed = changes.withColumns({"nxt": F.lead(TIME).over(w), "_isl": F.sum(F.when(F.col("shown"), 0).otherwise(1)).over(w)})
        held = timed.where("shown").join(closes, LOG).withColumn("nxt", F.coalesce("nxt", "close_us"))
        return _filled(_spans(held, lane, at.alias("_first"), F.col("_isl")), [LOG, *lane])
    timed = scan.along(changes, [LOG, *lane], [TIME, POS], width, _after=scan.following(TIME), _before=scan.previous(TIME, POS)).where("shown")
    held = timed.join(closes, LOG).withColumn("nxt", F.coalesce(f"_after.{TIME}", "close_us"))
    # A row that is not shown stands between two that are.
    return _encoded(held.withColumns({"_first": at, "_prior": F.col("_before")}), lane, width)


def _spans(rows: DataFrame, lane: list[str], *more: Column) -> DataFrame:
    return rows.select(LOG, *lane, F.col(TIME).alias("start_us"), F.col("nxt").alias("end_us"), "v", *more)


def _encoded(rows: DataFrame, lane: list[str], width: int) -> DataFrame:
    """Runs of rows (log_id, lane, t_us, nxt, v, _first, _prior): a row goes on from the one whose _first is its _prior.

    Runs are made in each stretch of time; the first ones of its first island and its
    last one may go on in other stretches, so those, three for each stretch and lane,
    go through the same again.
    """
    keys = [LOG, *lane]
    own = _spans(rows, lane, scan.stretch(width).alias("_stretch"), F.col("_first"), F.col("_first").alias("_last"), F.col("_prior"))
    parts = _filled(_islands(own, [*keys, "_stretch"]), [*keys, "_stretch"], open_start=True)
    last = F.max(F.struct("_isl", "_run")).over(Window.partitionBy(*keys, "_stretch"))
    told = written(parts.withColumn("_edge", ((F.col("_isl") == 1) & (F.col("_run") <= 1)) | (F.struct("_isl", "_run") == last)))
    met = _filled(_islands(told.where("_edge").drop("_isl", "_run"), keys), keys)
    out = [*keys, "start_us", "end_us", "v"]
    return told.where("not _edge").select(*out).unionByName(met.select(*out))


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("_first")
    return rows.withColumn("_isl", F.sum(F.when(F.lag("_last").over(w) == F.col("_prior"), 0).otherwise(1)).over(w))


def _filled(rows: DataFrame, keys: list[str], open_start: bool = False) -> DataFrame:
    """Rows (keys, _isl, _first, start_us, end_us, v) as runs, by island.

    ``open_start``: nulls that begin the first island stay apart, since a value may
    come before them; runs then carry what tells how they go on.
    """
    inside = Window.partitionBy(*keys, "_isl").orderBy("_first")
    # Where no value came before, the first one that follows is the island's first: a frame that is summed once, not for each row.
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("v", ignorenulls=True).over(whole)
    before = F.last("v", ignorenulls=True).over(inside)
    filled = rows.withColumn("vf", F.coalesce(before, F.when(F.col("_isl") > 1, first) if open_start else first))
    changed = (~F.col("vf").eqNullSafe(F.lag("vf").over(inside)) & F.lag(F.lit(1)).over(inside).isNotNull()).cast("int")
    runs = filled.withColumn("chg", changed).withColumn("_run", F.sum("chg").over(inside))
    links = [F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.min_by("_prior", "_first").alias("_prior")] if open_start else []
    out = runs.groupBy(*keys, "_isl", "_run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.first("vf", ignorenulls=True).alias("v"), *links)
    return out if open_start else out.drop("_isl", "_run")


def islands(rows: DataFrame, by: list[str], kind: Column) -> DataFrame:
    """``rows`` with ``run_end_us`` (half-open end of each sample) and ``grp``: consecutive rows of equal kind within ``by``."""
    w = ordered(*by)
    same = F.struct("_kind").eqNullSafe(F.lag(F.struct("_kind")).over(w))
    return (
        rows.withColumn("_kind", kind)
        .withColumn("run_end_us", last_sample_end(F.col(TIME), F.lead(TIME).over(w), F.lag(TIME).over(w)))
        .withColumn("_new", F.when(same, 0).otherwise(1))
        .withColumn("grp", F.sum("_new").over(w))
        .drop("_new")
        .withColumnRenamed("_kind", "kind")
    )


def island_spans(rows: DataFrame, by: list[str], kind: Column, extra: list[Column] = ()) -> DataFrame:
    """One row an island: kind, start_us, end_us (half-open), first_pos, n, and the kinds and start times of its neighbours."""
    spans = islands(rows, by, kind).groupBy(*by, "grp").agg(
        F.first("kind").alias("kind"),
        F.min(TIME).alias("start_us"),
        F.max("run_end_us").alias("end_us"),
        F.min(POS).alias("first_pos"),
        F.count(F.lit(1)).alias("n"),
        *extra,
    )
    w = Window.partitionBy(*by).orderBy("grp")
    return spans.select(
        "*",
        F.lag(F.struct("kind")).over(w).alias("before"),
        F.lead(F.struct("kind")).over(w).alias("after"),
        F.lead("start_us").over(w).alias("next_us"),
    )
