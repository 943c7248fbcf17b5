"""An archive of many logs: inventory, search, priority lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.functions.fuzzy import partial_ratio
from chronolane.functions.text import casefold
from chronolane.model import SUMMARY_VERSION

FIELDS = ("name", "instrument", "action", "popup", "banner", "text")
FUZZY_LEAST = 80


def state(footer: Column, version: Column) -> Column:
    return F.when(footer.isNull(), "running").when(version.eqNullSafe(F.lit(SUMMARY_VERSION)), "complete").otherwise("outdated")


def progress(last: Column, duration: Column) -> Column:
    """Share of the duration reached, 1 at most; null if either is unknown or the duration not positive."""
    return F.when((duration > 0) & last.isNotNull(), F.least(F.lit(1.0), F.round(last / duration, 4)))


def tokenize(query: str) -> list[tuple[str | None, str]]:
    """(field, text) of each token: a known ``field:`` narrows, quotes hold a phrase together, an open quote runs to the end."""
    out, rest = [], query.strip()
    while rest:
        field = None
        head, colon, tail = rest.partition(":")
        if colon and " " not in head and head.casefold() in FIELDS:
            field, rest = head.casefold(), tail.lstrip()
        stop = '"' if rest[:1] == '"' else " "
        text, _, rest = rest[rest[:1] == '"' :].partition(stop)
        rest = rest.lstrip()
        if text:
            out.append((field, text))
    return out


#: One token: a field name, and a phrase or a word.
TOKEN = rf"(?i)\s*(?:({'|'.join(FIELDS)}):\s*+)?+(?:\"([^\"]*)\"?|([^ \"][^ ]*+)?)"


def tokens(query: Column) -> Column:
    """``tokenize`` of a column: an array of structs (field, token); null for a null query."""
    text = F.trim(query)
    field, phrase, word = (F.regexp_extract_all(text, F.lit(TOKEN), F.lit(i)) for i in (1, 2, 3))
    all_ = F.transform(
        F.arrays_zip(field.alias("field"), phrase.alias("phrase"), word.alias("word")),
        lambda x: F.struct(F.when(x["field"] != "", F.lower(x["field"])).alias("field"), F.concat(x["phrase"], x["word"]).alias("token")),
    )
    return F.filter(all_, lambda x: x["token"] != "")


def _values(field: str | None, corpus: dict[str, Column]) -> Column:
    empty = F.array().cast("array<string>")
    if field is None:
        return F.concat(*corpus.values())
    if field == "text":
        return F.concat(corpus.get("popup", empty), corpus.get("banner", empty))
    return corpus.get(field, empty)


def matches(query: str, corpus: dict[str, Column], fuzzy: bool = True) -> Column:
    """Whether every token occurs in its field's values: as a part of one, case folded, else by partial ratio."""

    def one(field: str | None, text: str) -> Column:
        needle = F.lit(text.casefold())
        values = F.coalesce(_values(field, corpus), F.array().cast("array<string>"))
        found = F.exists(values, lambda v: casefold(v).contains(needle))
        if not fuzzy:
            return found
        joined = F.array_join(F.transform(values, lambda v: casefold(v)), "\n")
        return found | (partial_ratio(needle, joined, lines=True) >= FUZZY_LEAST)

    return reduce(Column.__and__, [one(f, t) for f, t in tokenize(query)], F.lit(True))


def search(entries: DataFrame, query: str, corpus: dict[str, Column], fuzzy: bool = True) -> DataFrame:
    """The entries whose corpus matches every token; an empty query matches all."""
    return entries.where(matches(query, corpus, fuzzy))


def cached_or_derived(cached: DataFrame, derived: DataFrame, key: str, version: int) -> DataFrame:
    """Rows from the cache where its version is current, derived ones for all other keys."""
    good = cached.where(F.col("version") == version).drop("version")
    return good.unionByName(derived.join(good.select(key).distinct(), key, "left_anti"))


def first_present(rows: DataFrame, key: str, candidates: list[Column], files: DataFrame) -> DataFrame:
    """``rows`` with ``found``: the first candidate name that is in ``files`` (name), in the order given; null if none."""
    asked = rows.select(key, F.posexplode(F.array(*candidates)).alias("rank", "name")).where("name is not null")
    hit = asked.join(files.select("name").distinct(), "name").groupBy(key).agg(F.min_by("name", "rank").alias("found"))
    return rows.join(hit, key, "left")
