"""Conversations whose turns broke, and their cheapest repair.

A repaired conversation reads ``(s?(ua)+)?`` by the first letters of its roles: an
optional system turn, then user and assistant by turns. Four states say where a
reader of that pattern stands. Each turn is a 4x4 matrix over (cost, audit): entry
(i, j) is the cheapest way through that turn from state i to state j, and the
letters of the edits taken, with any inserts that follow (the closure of
``Insert``). Matrices multiply in the (min, plus) sense, ties falling to the least
audit; that is associative, so turns can be multiplied in any grouping. (Of two
ways through the same turns one audit is never the beginning of an equally cheap
other: the longer one would have more inserts. So the tie rule holds under
products on both sides.)

Turns are dealt out by range of (conversation, turn). Each partition multiplies
its stretch of every conversation; only the first and the last stretch of a
partition can continue elsewhere, and those meet in a tree of ``FAN`` at a time. So
a conversation that holds a third of all turns is spread like any other. What
stays in one task is the SHA-256 of one conversation's repaired text, which is one
stream by definition: it reads sorted rows and keeps nothing but the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CONV, TURN, ROLE, TEXT = "conv_id", "turn", "role", "text"
WHITE = " \t\n\v\f\r"
#: Stretches that meet in one step of the tree.
FAN = 8
#: Turns whose product is remembered by what they are.
SHORT = 32
LONG = (1 << 63) - 1

START, SYSTEM, USER, ASSISTANT = range(4)
#: Which states a kept role leads from and to, and where an inserted or renamed turn leads.
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
#: An entry (cost, audit) or None; a matrix is 16 entries, row by row.
Entry = tuple[int, str] | None
Matrix = tuple[Entry, ...]


def _better(a: Entry, b: Entry) -> Entry:
    return b if a is None else a if b is None else min(a, b)


def times(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for i in range(0, 16, 4):
        for j in range(4):
            cost, ways = -1, []
            for m in range(4):
                x, y = a[i + m], b[4 * m + j]
                if x is None or y is None:
                    continue
                both = x[0] + y[0]
                if cost < 0 or both < cost:
                    cost, ways = both, [(x[1], y[1])]
                elif both == cost:
                    ways.append((x[1], y[1]))
            out.append((cost, min(p + q for p, q in ways)) if ways else None)
    return tuple(out)


def _closure() -> Matrix:
    """Any number of inserts, none included."""
    out: list[Entry] = [None] * 16
    for i in range(4):
        at, entry = i, (0, "")
        for _ in range(4):
            out[4 * i + at] = _better(out[4 * i + at], entry)
            at, entry = NEXT[at], (entry[0] + COST["I"], entry[1] + "I")
    return tuple(out)


INSERTS = _closure()


@lru_cache(maxsize=None)
def leaf(symbol: str) -> Matrix:
    """The matrix of one turn, inserts after it included.

    ``symbol``: the role's letter (s, u, a; o for any other); in upper case if the
    turn must go. A truncated turn is ``TRUNCATED`` of that letter.
    """
    role, extra = (symbol, 0) if symbol in "suaoSUAO" else (chr(ord(symbol) - SHIFT), 1)
    out: list[Entry] = [None] * 16
    for i in range(4):
        out[5 * i] = (COST["D"], "D")
        if role.islower():
            for j, edit in ((KEEPS[role].get(i), "K"), (NEXT[i], "R")):
                if j is not None:
                    out[4 * i + j] = _better(out[4 * i + j], (COST[edit] + extra, edit))
    return times(tuple(out), INSERTS)


#: Letters of truncated turns are this far from their roles' letters.
SHIFT = 0x100


def symbol(role: str, gone: bool, truncated: bool) -> str:
    return role.upper() if gone else chr(ord(role) + SHIFT) if truncated else role


@lru_cache(maxsize=1 << 15)
def product(symbols: str) -> Matrix:
    """The product of at most ``SHORT`` turns."""
    if len(symbols) == 1:
        return leaf(symbols)
    half = len(symbols) // 2
    return times(product(symbols[:half]), product(symbols[half:]))


class Stretch:
    """What is known of adjacent turns of one conversation; memory grows with their audits alone."""

    def __init__(self) -> None:
        self.open, self.parts = [], []  # letters not multiplied yet; (size, matrix), sizes falling
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = ""
        self.low = self.high = None

    def add(self, turn: int | None, role: str, fault: str) -> None:
        self.illegal += self.n > 0 and self.last + role not in ("su", "ua", "au")
        self.first, self.last, self.n = self.first or role, role, self.n + 1
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.open.append(symbol(role, fault in ("b", "d"), fault == "t"))
        if len(self.open) == SHORT:
            self._multiply()

    def _multiply(self) -> None:
        if self.open:
            size, now = 1, product("".join(self.open))
            while self.parts and self.parts[-1][0] <= size:
                before, left = self.parts.pop()
                size, now = size + before, times(left, now)
            self.parts.append((size, now))
            self.open = []

    def matrix(self) -> Matrix:
        self._multiply()
        _, out = self.parts[-1]
        for _, left in reversed(self.parts[:-1]):
            out = times(left, out)
        return out

    def row(self) -> tuple:
        entries = self.matrix()
        known = (self.n, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.turns)
        return (*known, [e and e[0] for e in entries], [e and e[1] for e in entries])


FIELDS = {
    "n": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "first": "string", "last": "string",
    "low": "long", "high": "long", "turns": "long", "costs": "array<long>", "audits": "array<string>",
}


def joined(a: dict, b: dict) -> dict:
    """Two adjacent stretches (rows of ``FIELDS``) as one."""
    out = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in ("su", "ua", "au"))
    out |= {"first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}
    out["turns"] = a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"])
    left, right = ([c if c is None else (c, s) for c, s in zip(x["costs"], x["audits"])] for x in (a, b))
    entries = times(tuple(left), tuple(right))
    return out | {"costs": [e and e[0] for e in entries], "audits": [e and e[1] for e in entries]}


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a whole conversation."""
    whole = times(INSERTS, matrix)
    return min(e for e in (whole[START], whole[ASSISTANT]) if e is not None)


def damaged(turns: DataFrame, conv_col: str = CONV, turn_col: str = TURN, role_col: str = ROLE, text_col: str = TEXT) -> DataFrame:
    """(conv_id, turn, role, text, uid): the turns after faults were put in by crc32 of ``conv_id:turn``, nulls read as one space.

    Of 20 remainders 0 drops the turn, 1 empties its text, 2 takes ``.``, ``!`` and
    ``?`` out of it, 3 repeats it, 4 makes its role ``user``. uid tells rows apart.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    rows = turns.select(
        F.col(conv_col).alias(CONV),
        F.col(turn_col).cast("long").alias(TURN),
        F.coalesce(F.col(role_col).cast("string"), space).alias(ROLE),
        F.coalesce(F.col(text_col).cast("string"), space).alias(TEXT),
        F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("_h"),
        F.monotonically_increasing_id().alias("_id"),
    )
    copies = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("_h <> 0").select("*", copies.alias("_copy")).select(
        CONV,
        TURN,
        F.when(F.col("_h") == 4, "user").otherwise(F.col(ROLE)).alias(ROLE),
        F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate(TEXT, ".!?", "")).otherwise(F.col(TEXT)).alias(TEXT),
        (F.col("_id") * 2 + F.col("_copy")).alias("uid"),
    )


def order() -> list[Column]:
    """Of conversations, of turns in one, and of rows of one turn."""
    return [F.asc_nulls_first(CONV), F.asc_nulls_first(TURN), F.asc("name"), F.asc("uid")]


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, name, uid, initial, fault) of the written rows; fault: b, d, t or empty, the first that holds."""
    # A row repeats an earlier one if another of its conversation, role and text comes first; the least is found with partial sums and met by its own number, so neither step has a hot key.
    own = rows.where("body <> ''").groupBy(CONV, "name").agg(F.min(F.struct(TURN, "uid")).alias("least")).select(F.col("least.uid").alias("uid"), F.lit(True).alias("fresh"))
    fault = F.when(F.col("body") == "", "b").when(F.col("fresh").isNull(), "d").when(~F.col("body").isin(".", "!", "?"), "t").otherwise("")
    return rows.join(own, "uid", "left").select(CONV, TURN, "name", "uid", "initial", fault.alias("fault"))


def _stretches(faults: DataFrame, kind: str) -> DataFrame:
    """One row for each conversation and partition; ``edge`` if the stretch could go on in another partition."""
    dealt = faults.repartitionByRange(*order()).sortWithinPartitions(*order()).select(CONV, F.spark_partition_id().alias("part"), TURN, "initial", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, begun, out, part = None, None, False, [], 0
        kinds = []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            names = [CONV, "part", "edge", *FIELDS]
            types = [*kinds, pa.bool_(), *[{"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}[t] for t in FIELDS.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            kinds = kinds or [batch.column(0).type, pa.int32()]
            for own, part, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or own != conv:
                    if now is not None:
                        out.append((conv, part, not begun, *now.row()))
                        begun = True
                    conv, now = own, Stretch()
                now.add(turn, initial, fault)
            if out:
                yield table(out)
                out = []
        if now is not None:
            yield table([(conv, part, True, *now.row())])

    own = ", ".join(f"{n} {t}" for n, t in FIELDS.items())
    return dealt.mapInArrow(run, f"{CONV} {kind}, part int, edge boolean, {own}")


def _met(edges: DataFrame) -> DataFrame:
    """Stretches that may belong together, joined in a tree; one row a conversation is left."""

    def run(own: pa.Table) -> pa.Table:
        rows = sorted(own.to_pylist(), key=lambda r: r["part"])
        out = rows[0] | {"part": rows[0]["part"] // FAN}
        for row in rows[1:]:
            out |= joined(out, row)
        return pa.Table.from_pylist([out], own.schema)

    most = edges.agg(F.max("part")).first()[0]
    while most:
        edges = edges.groupBy(CONV, F.floor(F.col("part") / FAN).alias("_to")).applyInArrow(run, edges.schema)
        most //= FAN
    return edges


RESULT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string"}
ARROW_RESULT = [pa.int64()] * 6 + [pa.string()]


def _results(stretches: DataFrame, kind: str) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of whole conversations."""

    names = [CONV, *RESULT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                cost, audit = cheapest(tuple(None if c is None else (c, s) for c, s in zip(row["costs"], row["audits"])))
                gaps = 0 if row["low"] is None else min(row["high"] - row["low"] + 1 - row["turns"], LONG)
                out.append((row[CONV], gaps, row["blank"], row["duplicate"], row["truncated"], row["illegal"], cost, audit))
            types = [batch.schema.field(CONV).type, *ARROW_RESULT]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return stretches.mapInArrow(run, f"{CONV} {kind}, " + ", ".join(f"{n} {t}" for n, t in RESULT.items()))


def edited(audit: str, at: int, state: int, role: bytes, text: bytes) -> tuple[list[bytes], int, int]:
    """The lines that one turn becomes, with those inserted before it; and where in the audit, and in which state, that ends."""
    lines = []
    while at < len(audit) and audit[at] == "I":
        state, at = NEXT[state], at + 1
        lines.append(NAMES[state].encode() + b":")
    if audit[at] == "K":
        state = KEEPS[role[:1].decode()][state]
        lines.append(role + b":" + text)
    elif audit[at] == "R":
        state = NEXT[state]
        lines.append(NAMES[state].encode() + b":" + text)
    return lines, at + 1, state


def _hashed(convs: DataFrame, results: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """The results of all conversations with the SHA-256 of their repaired lines, streamed through sorted partitions."""
    void: Column = F.lit(None)
    columns = [TURN, "name", "uid"]
    whole = convs.select(CONV, F.lit(0).alias("step"), *[void.cast(t).alias(n) for n, t in {TURN: "long", "name": "string", "uid": "long", ROLE: "binary", TEXT: "binary"}.items()], *[void.cast(t).alias(n) for n, t in RESULT.items()])
    told = results.select(CONV, F.lit(1).alias("step"), *RESULT)
    lines = rows.select(CONV, F.lit(2).alias("step"), *columns, F.col(ROLE).cast("binary").alias(ROLE), F.col(TEXT).cast("binary").alias(TEXT))
    union = whole.unionByName(told, allowMissingColumns=True).unionByName(lines, allowMissingColumns=True)
    dealt = union.repartition(CONV).sortWithinPartitions(F.asc_nulls_first(CONV), "step", F.asc_nulls_first(TURN), "name", "uid").select(CONV, "step", ROLE, TEXT, *RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, known, begun, kinds, out = None, None, False, None, []
        audit, at, state, digest, written_ = "", 0, START, None, False

        def put(lines: list[bytes]) -> None:
            nonlocal written_
            for line in lines:
                digest.update(b"\n" + line if written_ else line)
                written_ = True

        def close() -> None:
            if begun:
                put(edited(audit + "D", at, state, b"", b"")[0] if at < len(audit) else [])
                out.append((conv, *known, digest.hexdigest()))

        def table() -> pa.RecordBatch:
            types = [kinds, *ARROW_RESULT, pa.string()]
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[CONV, *RESULT, "repaired_sha256"])
            out.clear()
            return got

        for batch in batches:
            kinds = kinds or batch.column(0).type
            for own, step, role, text, *result in zip(*(c.to_pylist() for c in batch.columns)):
                if step == 0:
                    close()
                    conv, known, begun = own, (0, 0, 0, 0, 0, 0, ""), True
                    audit, at, state, digest, written_ = "", 0, START, hashlib.sha256(), False
                elif step == 1:
                    known, audit = result, result[-1]
                else:
                    lines, at, state = edited(audit, at, state, role, text)
                    put(lines)
            if out:
                yield table()
        close()
        if out:
            yield table()

    own = ", ".join(f"{n} {t}" for n, t in RESULT.items())
    return dealt.mapInArrow(run, f"{CONV} {kind}, {own}, repaired_sha256 string")


def repaired(turns: DataFrame, original: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conv_id of ``original``.

    ``turns``: (conv_id, turn, role, text, uid), none of role, text and uid null. Turns
    follow each other by turn, nulls first; rows of one turn by the MD5 of role and
    text. A turn's first fault counts: blank, duplicate (role and text seen earlier),
    truncated (not ended by ``.``, ``!`` or ``?``). A null conv_id is a conversation
    of its own. One without turns has zeros, an empty audit and the hash of nothing;
    an empty ``original`` gives no rows. Gaps beyond a long read as the greatest long.
    """
    body = F.rtrim(F.col(TEXT), F.lit(WHITE))
    role = F.substring(ROLE, 1, 1)
    rows = written(
        turns.select(
            CONV, TURN, ROLE, TEXT, "uid",
            F.md5(F.concat(F.length(ROLE).cast("string"), F.lit(":"), ROLE, TEXT).cast("binary")).alias("name"),
            F.right(body, F.lit(1)).alias("body"),
            F.when(role.isin("s", "u", "a"), role).otherwise("o").alias("initial"),
        )
    )
    kind = rows.schema[CONV].dataType.simpleString()
    parts = written(_stretches(_faults(rows), kind))
    results = _results(parts.where("not edge").drop("edge").unionByName(_met(parts.where("edge").drop("edge"))), kind)
    return _hashed(original.select(CONV).distinct(), results, rows, kind)


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """``repaired`` over ``damaged`` turns; null roles and texts are one space. Extra columns are not looked at."""
    return repaired(damaged(turns), turns)
