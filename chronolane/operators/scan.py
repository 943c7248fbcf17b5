"""Windows along one long log, in parallel.

A window over a whole log is one task. Where a log is too long for that, it is cut
into stretches of time. Each stretch has its own window; it is also summed up in one
row, those rows are folded along the log, and what lies before (or after) a
stretch is put into its rows. Every fold here is associative, so the result is the
same as that of one window. ``width`` is a stretch's length in microseconds; None
means plain windows. Rows that are scanned in stretches are written to the shared
folder first, when the plan is made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronolane.model import LOG, TIME
from chronolane.sources.shared import written

#: Rows of one log that go through one task as they are.
ROWS = 1_000_000


def width(rows: DataFrame, by: tuple[str, ...] = (LOG,), most: int = ROWS) -> int | None:
    """A stretch in which the densest log has about ``most`` rows; None if no log has more than that."""
    each = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.max(TIME) - F.min(TIME) + 1).alias("span"))
    found = each.where(F.col("n") > most).agg(F.min(F.col("span") / F.col("n")).alias("step")).first()["step"]
    return None if found is None else max(1, int(found * most))


@dataclass(frozen=True)
class Fold:
    """``local``: over a window of one stretch; ``summed``: of a stretch in an order; ``around``: of the sums over a window of stretches; ``merged``: a row's own and what is around it."""

    local: Callable[[WindowSpec, WindowSpec], Column]
    summed: Callable[[Column], Column]
    around: Callable[[Column, WindowSpec], Column]
    merged: Callable[[Column, Column], Column]


def _upto(w: WindowSpec, last: int = 0) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, last)


def ordinal() -> Fold:
    """The row's number, from 1."""
    return Fold(lambda w, _: F.row_number().over(w), lambda _: F.count(F.lit(1)), lambda s, w: F.coalesce(F.sum(s).over(_upto(w, -1)), F.lit(0)), lambda own, before: (own + before).cast("long"))


def total(x: Column) -> Fold:
    """The sum of ``x``, never null, up to the row."""
    return Fold(lambda w, _: F.sum(x).over(_upto(w)), lambda _: F.sum(x), lambda s, w: F.coalesce(F.sum(s).over(_upto(w, -1)), F.lit(0)), lambda own, before: own + before)


def carried(x: Column) -> Fold:
    """The last ``x`` that is not null, up to the row."""
    return Fold(
        lambda w, _: F.last(x, True).over(_upto(w)),
        lambda order: F.max_by(x, F.when(x.isNotNull(), order)),
        lambda s, w: F.last(s, True).over(_upto(w, -1)),
        F.coalesce,
    )


def coming(x: Column) -> Fold:
    """The first ``x`` that is not null, from the row on."""
    return Fold(
        lambda _, back: F.last(x, True).over(_upto(back)),
        lambda order: F.min_by(x, F.when(x.isNotNull(), order)),
        lambda s, w: F.first(s, True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        F.coalesce,
    )


def previous(*x: Column | str) -> Fold:
    """The struct of ``x`` of the row before, null at the first row."""
    return Fold(lambda w, _: F.lag(F.struct(*x)).over(w), lambda order: F.max_by(F.struct(*x), order), lambda s, w: F.lag(s).over(w), F.coalesce)


def following(*x: Column | str) -> Fold:
    """The struct of ``x`` of the row after, null at the last row."""
    return Fold(lambda w, _: F.lead(F.struct(*x)).over(w), lambda order: F.min_by(F.struct(*x), order), lambda s, w: F.lead(s).over(w), F.coalesce)


def stretch(width: int | None) -> Column:
    """The number of a row's stretch."""
    return F.lit(0).cast("long") if width is None else F.floor(F.col(TIME) / width)


def along(rows: DataFrame, by: list[str], order: list[str], width: int | None, **folds: Fold) -> DataFrame:
    """``rows`` with a column for each fold (in place of one of that name), by ``by`` (no nulls) in ``order``, which must rise with t_us and has no ties."""
    keys = by if width is None else [*by, "_stretch"]
    # Read for the windows and for the sums; a chain of scans would compute its first rows over and over.
    here = rows if width is None else written(rows.withColumn("_stretch", stretch(width)))
    w = Window.partitionBy(*keys).orderBy(*order)
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    own = here.withColumns({name: f.local(w, back) for name, f in folds.items()})
    if width is None:
        return own
    sums = here.groupBy(*keys).agg(*[f.summed(F.struct(*order)).alias(f"_scan_{name}") for name, f in folds.items()])
    whole = Window.partitionBy(*by).orderBy("_stretch")
    around = sums.select(*keys, *[f.around(F.col(f"_scan_{name}"), whole).alias(f"_scan_{name}") for name, f in folds.items()])
    both = own.join(around, keys)
    return both.withColumns({name: f.merged(F.col(name), F.col(f"_scan_{name}")) for name, f in folds.items()}).select(*[c for c in rows.columns if c not in folds], *folds)
