"""Repair of conversations against a search over edits, written from the contract."""

import hashlib
import random
import zlib

import pytest

from chronolane.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, uid string, part int, name string"
WHITE = " \t\n\v\f\r"


def faulted(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def legal(initials):
    rest = initials.removeprefix("s")
    return initials == "" or len(rest) >= 2 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2)


def searched(turns):
    """Least (cost, audit) over all edits: states are what has been written so far, kept for each letter-pattern state."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}  # by the last letter written
    best = {"": (0, "", ())}

    def inserts(now):
        now = dict(now)
        for _ in range(4):
            for last, (c, a, lines) in list(now.items()):
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if letter in follow[last]:
                        new = (c + 2, a + "I", (*lines, f"{name}:"))
                        if letter not in now or new[:2] < now[letter][:2]:
                            now[letter] = new
        return now

    best = inserts(best)
    for role, text, fault in turns:
        after = {}

        def put(letter, new):
            if letter not in after or new[:2] < after[letter][:2]:
                after[letter] = new

        for last, (c, a, lines) in best.items():
            put(last, (c + 3, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if role[:1] in follow[last] and role[:1]:
                put(role[:1], (c + extra, a + "K", (*lines, f"{role}:{text}")))
            for letter, name in (("u", "user"), ("a", "assistant")):
                if letter in follow[last]:
                    put(letter, (c + 2 + extra, a + "R", (*lines, f"{name}:{text}")))
        best = inserts(after)
    cost, audit, lines = min(best[x] for x in ("", "a") if x in best)
    assert legal("".join(x[0] for x in lines))
    return cost, audit, "\n".join(lines)


def brute(rows):
    out = {conv: (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    by = {}
    for row in faulted(rows):
        by.setdefault(row[0], []).append(row)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        seen, turns, faults = set(), [], []
        for _, _, role, text in own:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            turns.append((role, text, fault))
        letters = [t[0][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, text = searched(turns)
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return list(out.values())


def same(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x", 7, "n") for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r) for r in repair.damaged_and_repaired(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def conversations(seed, n, most):
    rnd = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rnd.randint(1, most)):
            role = rnd.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "student"])
            text = rnd.choice(["Yes.", "No!", "why?", "so", "", None, " \t", "Ünï 漢字.", "a  \n", f"{turn}.", f"{turn}"])
            out.append((rnd.choice([conv, conv, conv, None]), rnd.choice([turn, turn, turn, None, -3]), role, text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_over_edits(spark, seed):
    same(spark, conversations(seed, 40, 9))


def test_long_conversation_over_many_partitions(spark):
    rnd = random.Random(4)
    rows = [(7, t, rnd.choice(["user", "assistant"]), rnd.choice(["Yes.", f"{t}.", f"{t}", f"{t} {t}."])) for t in range(3000)]
    rows += [(8, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(5)] + [(6, 0, "user", "same.")] * 200
    same(spark, rows, parts=7)


def test_one_very_long_text_and_empty_table(spark):
    same(spark, [(1, 0, "user", "word " * 200_000), (1, 1, "assistant", "x" * 300_000 + "."), (2, 2**62, "user", "a."), (2, -(2**62), "assistant", "b.")])
    df = spark.createDataFrame([], SCHEMA)
    assert repair.damaged_and_repaired(df).collect() == []


def test_products_are_the_same_in_any_grouping():
    rnd = random.Random(9)
    for _ in range(200):
        letters = [repair.symbol(rnd.choice("suao"), rnd.random() < 0.2, rnd.random() < 0.2) for _ in range(rnd.randint(2, 12))]
        left = repair.leaf(letters[0])
        for x in letters[1:]:
            left = repair.times(left, repair.leaf(x))
        right = repair.leaf(letters[-1])
        for x in reversed(letters[:-1]):
            right = repair.times(repair.leaf(x), right)
        assert left == right == repair.product("".join(letters))
        own = repair.Stretch()
        for x in "suao":
            own.add(1, x, "")
        assert own.matrix() == repair.product("suao")
