"""The observation model: what a log's rows look like, and what they mean.

An observation says that at time ``t_us`` (integer microseconds), in frame
``frame``, the sensor ``signal`` read something about ``key``. A value updates the
key, a null value clears it (confirmed absence), and no row at all leaves it as
it was. ``pos`` is the row's place in its log: of two rows at one time the later
one wins, so every order is (t_us, pos).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG, TIME, POS = "log_id", "t_us", "pos"
MICROS = 1_000_000

OBSERVATION = T.StructType(
    [
        T.StructField(LOG, T.StringType(), False),
        T.StructField(POS, T.LongType(), False),
        T.StructField(TIME, T.LongType(), False),
        T.StructField("frame", T.LongType(), False),
        T.StructField("signal", T.StringType(), False),
        T.StructField("key", T.ArrayType(T.StringType()), False),
        T.StructField("value", T.StringType(), True),  # JSON text; null is a confirmed absence
        T.StructField("score", T.DoubleType(), True),
    ]
)

#: Fixed values of the wire format: the signals, and the payload tag each may carry.
PAYLOAD_OF = {
    "layout": "geometry",
    "status": "status",
    "arm": "digit",
    "instrument": "instrument",
    "pedals": "press",
    "pedal_label": "label",
    "laser": "laser",
    "popups": "popups",
    "banner": "banner",
    "offscreen": "offscreen",
    "tool_association": "badges",
}
STATUSES = ("active", "inactive", "warning")
COLORS = ("yellow", "blue")
ROLES = ("camera", "instrument")
LOG_VERSION = SUMMARY_VERSION = INTERVALS_VERSION = 1


def micros(seconds: Column) -> Column:
    return F.round(seconds * MICROS).cast("long")


def seconds(t_us: Column) -> Column:
    return t_us / F.lit(float(MICROS))


def checked_signal(signal: Column) -> Column:
    """The signal, or an error for a name outside the format."""
    return F.when(signal.isin(*PAYLOAD_OF), signal).otherwise(
        F.raise_error(F.concat(F.lit("unknown signal: "), F.coalesce(signal, F.lit("null"))))
    )


def typed_payload(value: Column, signal: str) -> Column:
    """A payload's JSON text if it carries the signal's tag, an error if it carries another, null if it is null."""
    tag = F.get_json_object(value, "$.type")
    return F.when(value.isNull() | (tag == PAYLOAD_OF[signal]), value).otherwise(
        F.raise_error(F.concat(F.lit(f"not a {signal} payload: "), F.coalesce(tag, F.lit("null"))))
    )
