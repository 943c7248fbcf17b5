"""String functions that Spark has no built-in for, or none with these semantics."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def casefold(text: Column) -> Column:
    """Lower case with the sharp s unfolded: full case folding for Latin text, inside code generation."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(T.StringType())
def casefold_full(text: pd.Series) -> pd.Series:
    """Unicode case folding of any script."""
    return text.str.casefold()


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized(text: Column) -> Column:
    """Folded, punctuation as blanks, blanks squeezed."""
    return squeezed(F.regexp_replace(casefold(text), r"(?U)[^\w\s]", " "))


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Lower case, words hyphenated over a line break joined, accents dropped, all but a-z and 0-9 as single blanks."""

    def one(s: str) -> str:
        s = s.lower().replace("-\n", "").replace("ß", "ss")
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not "̀" <= c <= "ͯ")
        return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in s).split())

    return text.map(one, na_action="ignore")


def titled(name: Column) -> Column:
    """Underscores as blanks, each word with a capital, its tail as it was."""
    words = F.split(F.replace(name, F.lit("_"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def aligned(rows: DataFrame, columns: list[str]) -> tuple[str, str, DataFrame]:
    """A text table: header, rule, and ``rows`` with ``line``, cells left-justified under their headers, two blanks apart.

    Nulls are empty cells. Widths are one aggregate over all rows; the driver gets those alone.
    """
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    found = rows.agg(*[F.max(F.length(x)).alias(c) for c, x in cells.items()]).first()
    widths = {c: max(len(c), found[c] or 0) for c in columns}
    line = F.rtrim(F.concat_ws("  ", *[F.rpad(x, widths[c], " ") for c, x in cells.items()]))
    return "  ".join(c.ljust(n) for c, n in widths.items()).rstrip(), "  ".join("─" * n for n in widths.values()), rows.withColumn("line", line)
