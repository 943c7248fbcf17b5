"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel of two words counts their common three-letter subsequences, each
weighted by ``DECAY`` to the letters it spans in either word, and is divided by
the norms that words of their lengths have if no subsequence repeats. Letters put between, dots, hyphens and blanks inside a word
therefore cost a little and hide nothing. A document meets a landmark through
its best word; kernels under ``LEAST`` count as zero, which lets a cheap upper
bound skip most words without changing a result.

``fit`` reads at most ``max_rows`` labelled rows (a documented bound on the
sample, drawn by hash). Counting words and computing kernels run on executors;
the driver sees the words that mark the toxic label (at most ``CANDIDATES``)
and ``max_rows`` short vectors. Scoring is one Arrow pass over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOC_ID, TEXT, lean, texts, written

DECAY, SPAN, LEAST = 0.6, 7, 0.3
#: Letters of a piece of a word; longer words are taken in overlapping pieces.
PIECE = 16
LANDMARKS, CANDIDATES, MIN_DOCS = 48, 600, 3
#: Words whose kernels a worker keeps.
KEPT_WORDS = 300_000
_DROP = re.compile(r"[^\w\s]+|[\d_]+")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]\s+){3,}[^\W\d_](?!\S)")


def words_of(text: str) -> set[str]:
    """Lower-case words, each without what is not a letter; letters set apart by blanks are also one word."""
    plain = _DROP.sub("", text.lower())
    out = set(plain.split())
    for m in _SPACED.finditer(plain):
        out.add("".join(m.group().split()))
    return out


def _pieces(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


_triples: dict[int, list[tuple[int, int, int]]] = {}


def triples(n: int) -> list[tuple[int, int, int]]:
    if n not in _triples:
        _triples[n] = [t for t in combinations(range(n), 3) if t[2] - t[0] < SPAN]
    return _triples[n]


def _features(word: str) -> dict[str, float]:
    out: dict[str, float] = {}
    for i, j, k in triples(len(word)):
        u = word[i] + word[j] + word[k]
        out[u] = out.get(u, 0.0) + DECAY ** (k - i + 1)
    return out


_norms: dict[int, float] = {}


def norm(n: int) -> float:
    if n not in _norms:
        _norms[n] = float(np.sqrt(sum(DECAY ** (2 * (k - i + 1)) for i, _, k in triples(n)))) or 1.0
    return _norms[n]


def kernel(a: str, b: str) -> float:
    """The normalised kernel of two words of at most ``PIECE`` letters, straight from its definition."""
    fa, fb = _features(a), _features(b)
    return sum(x * fb.get(u, 0.0) for u, x in fa.items()) / (norm(len(a)) * norm(len(b)))


class Matcher:
    """Kernels of many words with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        letters = sorted({c for w in landmarks for c in w})
        self.letter = {c: i + 1 for i, c in enumerate(letters)}  # 0: a letter of no landmark
        m = self.m = len(letters) + 1
        self.table = np.zeros((m**3, len(landmarks)), np.float32)
        for at, word in enumerate(landmarks):
            for u, x in _features(word).items():
                a, b, c = (self.letter[z] for z in u)
                self.table[(a * m + b) * m + c, at] = x / norm(len(word))
        #: For the bound: the most that any landmark of each of a few groups has of a subsequence.
        groups = np.array_split(np.arange(len(landmarks)), min(6, max(1, len(landmarks))))
        self.bound = np.stack([self.table[:, g].max(axis=1, initial=0) for g in groups], axis=1)
        self.rows: dict[str, int] = {}
        self.matrix = np.zeros((1, len(landmarks)), np.float32)

    def _summed(self, codes: np.ndarray, table: np.ndarray) -> np.ndarray:
        n, m = len(codes), self.m
        sums = np.zeros((codes.shape[1], table.shape[1]), np.float32)
        for i in range(n - 2):
            for j in range(i + 1, min(n - 1, i + SPAN - 1)):
                pair = (codes[i] * m + codes[j]) * m
                for k in range(j + 1, min(n, i + SPAN)):
                    sums += np.float32(DECAY ** (k - i + 1)) * table.take(pair + codes[k], axis=0)
        return sums

    def _kernels(self, words: list[str]) -> np.ndarray:
        """One row for each word; the words have one length."""
        n = len(words[0])
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if n < 3 or not self.landmarks:
            return out
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        seen, flat = np.unique(points, return_inverse=True)
        ids = np.array([self.letter.get(chr(c), 0) for c in seen], np.intp)
        codes = ids[flat.reshape(points.shape)].T
        least = LEAST * norm(n)
        live = np.nonzero((self._summed(codes, self.bound) >= least * 0.999).any(axis=1))[0]
        if len(live):
            sums = self._summed(np.ascontiguousarray(codes[:, live]), self.table)
            out[live] = np.where(sums >= least, sums / norm(n), 0)
        return out

    def learn(self, words: list[str]) -> None:
        """Compute and keep the rows of words not met before; row 0 is zero and serves all words without a match."""
        if len(self.rows) > KEPT_WORDS:
            self.rows, self.matrix = {}, self.matrix[:1]
        piece_words = [(p, w) for w in words for p in _pieces(w)]
        by_size: dict[int, list[tuple[str, str]]] = {}
        for p, w in piece_words:
            by_size.setdefault(len(p), []).append((p, w))
        found: dict[str, np.ndarray] = {}
        for group in by_size.values():
            rows = self._kernels([p for p, _ in group])
            for at in np.nonzero(rows.any(axis=1))[0]:
                w = group[at][1]
                found[w] = np.maximum(found[w], rows[at]) if w in found else rows[at]
        self.rows.update(dict.fromkeys(words, 0))
        if found:
            self.rows.update(zip(found, range(len(self.matrix), len(self.matrix) + len(found))))
            self.matrix = np.concatenate([self.matrix, np.stack([*found.values()])])

    def vectors(self, batch: list[str]) -> np.ndarray:
        """For each text its best kernel with every landmark."""
        out = np.zeros((len(batch), len(self.landmarks)), np.float32)
        for at in range(0, len(batch), 64):
            sets = [words_of(t) for t in batch[at : at + 64]]
            self.learn([w for w in set().union(*sets) if w not in self.rows] if len(self.rows) <= KEPT_WORDS else [*set().union(*sets)])
            for i, own in enumerate(sets):
                rows = {self.rows[w] for w in own} - {0}
                if rows:
                    out[at + i] = self.matrix[[*rows]].max(axis=0)
        return out


@dataclass
class ToxicityModel:
    landmarks: list[str]
    weights: np.ndarray  # of the landmarks' kernels: the machine's weights times the Nystroem map
    bias: float
    slope: float
    offset: float

    def score(self, vectors: np.ndarray) -> np.ndarray:
        margin = vectors.astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _choose_landmarks(words: dict[str, int]) -> list[str]:
    """Words or parts of words, at most ``LANDMARKS``, that cover the most toxic documents of the words given."""
    parts: dict[str, set[str]] = {}
    for w in words:
        for n in range(4, min(len(w), 12) + 1):
            for i in range(len(w) - n + 1):
                parts.setdefault(w[i : i + n], set()).add(w)
    left, out = dict(words), []
    while left and len(out) < LANDMARKS:
        best = max(parts, key=lambda p: (sum(left.get(w, 0) for w in parts[p]) * min(len(p), 8), p), default=None)
        if best is None or not any(w in left for w in parts[best]):
            break
        out.append(best)
        for w in parts.pop(best):
            left.pop(w, None)
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps; y is -1 or 1."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    balance = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    w, held = np.zeros(x1.shape[1]), None
    for _ in range(50):
        inside = y * (x1 @ w) < 1
        if held is not None and np.array_equal(inside, held):
            break
        held, xs, c = inside, x1[inside], balance[inside]
        w = np.linalg.solve(ridge + (xs * c[:, None]).T @ xs, (xs * c[:, None]).T @ y[inside])
    return w[:-1], float(w[-1])


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset for labels 0 and 1."""
    hit = (y.sum() + 1) / (y.sum() + 2)
    miss = 1 / ((1 - y).sum() + 2)
    target, t = np.where(y > 0, hit, miss), np.zeros(2)
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        t += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, label_col: str = "toxic") -> ToxicityModel:
    """Learn from ``labels`` (doc_id and a 0/1 column; null labels and ids are skipped, of repeated ids the greatest label counts).

    Of documents that share a labelled id the longest text is learnt from, so the
    sample has ``max_rows`` rows at most. The map to landmarks is Nystroem's in
    form: kernels under ``LEAST`` are zero and a document takes each landmark's
    best word, which is no longer a positive definite kernel.

    Without both labels there is nothing to tell apart: every score is then the
    share of toxic labels (0 without labels).
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(DOC_ID).isNotNull())
        .groupBy(DOC_ID)
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
        .orderBy(F.xxhash64(DOC_ID), DOC_ID)
        .limit(max_rows)
    )
    # max_rows pairs of numbers at most, so the broadcast is bounded.
    found = texts(docs).join(F.broadcast(known), DOC_ID)
    sample = written(found.groupBy(DOC_ID).agg(F.first("y").alias("y"), F.max_by(TEXT, F.struct(F.length(TEXT), F.xxhash64(TEXT))).alias(TEXT)).select("y", TEXT))

    @lean
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [words_of(t) for t in pdf[TEXT]]
            yield pd.DataFrame({"y": np.repeat(pdf["y"].to_numpy(), [len(s) for s in sets]), "word": [w for s in sets for w in s]})

    counts = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = counts.get(0, 0), counts.get(1, 0)
    flat = float(toxic > 0) if not clean or not toxic else 0.5
    nothing = ToxicityModel([], np.zeros(0), 0.0, 0.0, 30.0 if flat == 1.0 else -30.0)
    if not clean or not toxic:
        return nothing
    marks = (
        sample.mapInPandas(split, "y int, word string")
        .groupBy("word")
        .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
        .where((F.col("toxic") >= MIN_DOCS) & (F.length("word") >= 4))
        .where((F.col("toxic") + 0.5) / toxic > 20 * (F.col("clean") + 0.5) / clean)
        .orderBy(F.desc("toxic"), "word")
        .limit(CANDIDATES)
        .collect()
    )
    landmarks = _choose_landmarks({r["word"]: r["toxic"] for r in marks})
    if not landmarks:
        return nothing

    @lean
    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(landmarks)
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "x": [*matcher.vectors(pdf[TEXT].tolist())]})

    rows = sample.mapInPandas(seen, "y int, x array<float>").toPandas()
    x, y = np.stack(rows["x"].map(np.asarray)).astype(np.float64), rows["y"].to_numpy()
    own = np.array([[kernel(a, b) for b in landmarks] for a in landmarks])
    values, vectors = np.linalg.eigh(own)
    nystroem = vectors @ np.diag(np.clip(values, 1e-3, None) ** -0.5) @ vectors.T
    w, bias = _machine(x @ nystroem, np.where(y > 0, 1.0, -1.0))
    margin = x @ nystroem @ w + bias
    return ToxicityModel(landmarks, nystroem @ w, bias, *_calibrated(margin, y.astype(float)))


def scored(model: ToxicityModel, text: Column) -> Column:
    """The score of a text column, 0 to 1; a null text is read as empty."""

    @F.pandas_udf("double")
    @lean
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model.landmarks)
        for batch in batches:
            yield pd.Series(model.score(matcher.vectors(batch.fillna("").tolist())))

    return run(text.cast("string"))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row of ``docs``, from its whole text."""
    return docs.select(F.col(DOC_ID), scored(model, F.col(TEXT)).alias("score"))
