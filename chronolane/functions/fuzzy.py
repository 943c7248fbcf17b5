"""Indel similarity of strings, 0 to 100, as Arrow functions.

``ratio`` is 200 times the longest common subsequence over both lengths.
``partial_ratio`` is the best ratio of the shorter string with any window of the
longer one; windows cut off at either end count too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors over ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_bits = full
    for c in b:
        hit = open_bits & where.get(c, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(a) - open_bits.bit_count()


def ratio_of(a: str, b: str) -> float:
    size = len(a) + len(b)
    return 100.0 if size == 0 else 200.0 * common_subsequence(a, b) / size


def partial_ratio_of(a: str, b: str) -> float:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0

    def best(short: str, long: str) -> float:
        n, top = len(short), 0.0
        letters = set(short)
        end = 1
        while end < len(long) + n:
            window = long[max(0, end - n) : end]
            # A window that starts or ends with a foreign letter is never better than its neighbour.
            if window[-1] not in letters and end < len(long):
                end += 1
                continue
            common = common_subsequence(short, window)
            top = max(top, 200.0 * common / (n + len(window)))
            # One step adds one letter, so whole windows before the one that could be better are passed over.
            ahead = int(top * n / 100 + 1e-9) + 1 - common if n <= end < len(long) else 1
            end = min(end + ahead, len(long)) if ahead > 1 else end + 1
        return top

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


class Phrases:
    """Many phrases against a text at once: their letters lie in one bit vector, a free bit between two phrases keeps their carries apart."""

    def __init__(self, phrases: list[str]) -> None:
        self.phrases = phrases
        self.sizes = np.array([len(p) for p in phrases], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]).astype(np.int64) if phrases else np.zeros(0, np.int64)
        self.bytes = (int((self.sizes + 1).sum()) + 7) // 8
        letters: dict[str, bytearray] = {}
        full = bytearray(self.bytes)
        for phrase, start in zip(phrases, self.starts.tolist()):
            for i, c in enumerate(phrase, start):
                own = letters.get(c)
                if own is None:
                    own = letters[c] = bytearray(self.bytes)
                own[i >> 3] |= 1 << (i & 7)
                full[i >> 3] |= 1 << (i & 7)
        self.where = {c: int.from_bytes(v, "little") for c, v in letters.items()}
        self.full = int.from_bytes(full, "little")

    def common(self, text: str) -> list[int]:
        """Lengths of the longest common subsequences with the text, in one pass over it."""
        if not self.phrases:
            return []
        open_bits = self.full
        for c in text:
            letters = self.where.get(c)
            if letters is not None:
                hit = open_bits & letters
                open_bits = ((open_bits + hit) | (open_bits - hit)) & self.full
        bits = np.unpackbits(np.frombuffer(open_bits.to_bytes(self.bytes, "little"), np.uint8), bitorder="little")
        return (self.sizes - np.add.reduceat(bits, self.starts, dtype=np.int64)).tolist()

    def best(self, text: str, least: float) -> tuple[int, float] | None:
        """The phrase with the greatest partial ratio of ``least`` or more, the first of equals.

        A window has no more in common with a phrase than the whole text has, and is
        at least as long as that; so phrases that cannot reach are never compared.
        """
        bounds = []
        for i, (phrase, common) in enumerate(zip(self.phrases, self.common(text))):
            short = min(len(phrase), len(text))
            bounds.append((-(200.0 * common / (short + common) if short + common else partial_ratio_of(phrase, text)), i))
        found: tuple[float, int] | None = None
        for bound, i in sorted(bounds):
            if -bound < least - 1e-9 or (found is not None and -bound < found[0] - 1e-9):
                break
            score = partial_ratio_of(self.phrases[i], text)
            if score >= least and (found is None or (-score, i) < (-found[0], found[1])):
                found = (score, i)
        return None if found is None else (found[1], found[0])


def best_phrase(text: Column, phrases: list[str], least: float) -> Column:
    """A struct (place, score) of the phrase most like a part of ``text``, or the other way round; null if none reaches ``least``. One Arrow call for all phrases; repeated texts are scored once a batch."""
    many = Phrases(phrases)

    def run(texts: pd.Series) -> pd.DataFrame:
        known = {x: many.best(x, least) for x in set(texts) if x is not None}
        hits = [known.get(x) or (None, None) for x in texts]
        return pd.DataFrame({"place": pd.array([h[0] for h in hits], "Int32"), "score": pd.array([h[1] for h in hits], "Float64")})

    hit = F.pandas_udf(run, "place int, score double")(text)
    return F.when(hit["place"].isNotNull(), hit)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if None in pair:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = partial_ratio_of(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def _partial_lines(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [None if x is None or y is None else max((partial_ratio_of(x, line) for line in y.split("\n")), default=0.0) for x, y in zip(a, b)],
        dtype="float64",
    )


def ratio(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def partial_ratio(a: Column, b: Column, lines: bool = False) -> Column:
    """``lines``: the best of b's lines."""
    return _partial_lines(a, b) if lines else _partial(a, b)
