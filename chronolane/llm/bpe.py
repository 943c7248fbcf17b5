"""Byte-pair encoding of whole documents with content-defined chunk reuse.

Documents are routed by the smallest fingerprint of their chunks, so that
copies and near copies meet in one partition; the adaptive rebalance splits a
partition that a hot group makes too large. Inside a task, texts are cut where
a rolling hash of the last characters says so (the cut moves with the content,
not with the offset), and every chunk is encoded once and kept in a bounded
cache. A cut may fall inside a word, so each join is repaired: what lies between
a safe boundary before the cut and one after it is encoded again. Both must be
ends of tokens in the chunks they lie in; where one is not, the next safe
boundary outwards is tried, until old and new tokens agree.

A safe boundary is a single space between two non-space characters. The
vocabulary's pattern takes a space only as the first character of a token, so
no token crosses such a place, and neither side's tokens depend on the other's.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC_ID, TEXT, lean, texts, utf8

#: Characters: shortest chunk, mask of the rolling hash (a cut each 600 or so), longest chunk, hash window.
SHORTEST, MASK, LONGEST, WINDOW = 128, 511, 4096, 16
#: Characters of chunk text that a task keeps with their ids.
CACHE_CHARS = 8_000_000
#: Below this code point every Unicode version classes characters alike.
LATIN_END = 0x250
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_FAR = re.compile("[^\x00-ɏ]")
_POWERS = np.array([pow(0x5851F42D4C957F2D, i, 1 << 64) for i in range(WINDOW)], np.uint64)


def cut_points(text: str) -> list[int]:
    """Ends of the content-defined chunks of ``text``, the last is its length."""
    n = len(text)
    if n <= SHORTEST:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        h += codes[i : i + len(h)] * _POWERS[i]
    h ^= h >> np.uint64(29)
    marks = np.nonzero(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(MASK) == 0)[0] + WINDOW
    out, last = [], 0
    for at in [*marks.tolist(), n]:
        while at - last > LONGEST:
            last += LONGEST
            out.append(last)
        if at - last >= SHORTEST or at == n:
            if at > last:
                out.append(at)
            last = at
    return out


def route(text: str) -> int:
    """The smallest fingerprint of the text's chunks, so that texts which share most chunks mostly agree."""
    best, last = None, 0
    for at in cut_points(text):
        h = int.from_bytes(hashlib.blake2b(utf8(text[last:at]), digest_size=8).digest(), "little", signed=True)
        best, last = h if best is None or h < best else best, at
    return best or 0


class Codec:
    """Encoder and decoder of one vocabulary. ``ranks_path``: the vocabulary as ranks; ``json_path``: for the tokenizers library.

    Chunks of Latin characters go to the faster of the two libraries, all others to
    the tokenizers library itself, whose Unicode tables then decide.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        self.json_path, self.pattern = json_path, pattern
        with open(json_path, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.added = added
        self.bytes_of = [b""] * (max([*self.ranks.values(), *added.values()]) + 1)
        for piece, i in [*self.ranks.items(), *((utf8(t), i) for t, i in added.items())]:
            self.bytes_of[i] = piece
        self.size_of = np.array([len(x) for x in self.bytes_of], np.int64)
        self.kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.kept_chars = 0

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.json_path)
        own.no_truncation()
        own.no_padding()
        return own

    @cached_property
    def fast(self):
        import tiktoken

        return tiktoken.Encoding("chunks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens=self.added)

    def encode_piece(self, piece: str) -> list[int]:
        if _FAR.search(piece):
            return self.slow.encode(piece, add_special_tokens=False).ids
        if any(a in piece for a in self.added):
            return self.fast.encode(piece, allowed_special="all")
        return self.fast.encode_ordinary(piece)

    def encode_chunk(self, chunk: str) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's tokens, and the byte in it at which each of them ends."""
        known = self.kept.get(chunk)
        if known is None:
            ids = np.array(self.encode_piece(chunk), np.int32)
            known = ids, np.cumsum(self.size_of[ids])
            self.kept_chars += len(chunk)
            while self.kept_chars > CACHE_CHARS and self.kept:
                self.kept_chars -= len(oldest := next(iter(self.kept)))
                del self.kept[oldest]
            self.kept[chunk] = known
        return known

    def encode(self, text: str) -> np.ndarray:
        cuts = cut_points(text)
        if len(cuts) < 2:
            return self.encode_chunk(text)[0] if text else np.zeros(0, np.int32)
        edges = [0, *cuts]
        gaps: list[list[int]] = []
        for cut in cuts[:-1]:
            done = gaps[-1][1] if gaps else 0
            if gaps and cut <= done:
                continue  # a repair before this cut reaches past it
            low, high = _safe_around(text, cut, done)
            while low > done and not self._ends(text, edges, low, bisect_left(edges, low) - 1):
                low, _ = _safe_around(text, low - 1, done)
            while high < len(text) and not self._ends(text, edges, high, bisect_right(edges, high) - 1):
                _, high = _safe_around(text, high + 1, done)
            if gaps and low <= done:
                gaps[-1][1] = high
            else:
                gaps.append([low, high])
        out: list[np.ndarray] = []
        done = 0
        for low, high in [*gaps, (len(text), len(text))]:
            if done < low:  # no cut lies between two repairs, so one chunk holds all of text[done:low]
                start = edges[bisect_right(edges, done) - 1]
                end = edges[bisect_left(edges, low)]
                ids, ends = self.encode_chunk(text[start:end])
                first, last = (np.searchsorted(ends, len(utf8(text[start:at])), "right") for at in (done, low))
                out.append(ids[first:last])
            if low < high:
                out.append(np.array(self.encode_piece(text[low:high]), np.int32))
            done = high
        return np.concatenate(out)

    def _ends(self, text: str, edges: list[int], at: int, chunk: int) -> bool:
        """Whether a token of that chunk ends, or the chunk begins, at ``at``."""
        _, ends = self.encode_chunk(text[edges[chunk] : edges[chunk + 1]])
        byte = len(utf8(text[edges[chunk] : at]))
        place = np.searchsorted(ends, byte)
        return byte == 0 or (place < len(ends) and ends[place] == byte)

    def encode_all(self, texts_: list[str]) -> list[np.ndarray]:
        """The ids of each text; equal texts are encoded once."""
        whole: dict[str, np.ndarray] = {}
        for text in texts_:
            if text not in whole:
                whole[text] = self.encode(text)
        return [whole[text] for text in texts_]

    def forget_chunks(self) -> None:
        self.kept, self.kept_chars = {}, 0

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _safe_around(text: str, cut: int, least: int) -> tuple[int, int]:
    """The last safe boundary at or before ``cut`` (not before ``least``), and the first one at or after it."""
    low, span = None, 64
    while low is None:
        at = max(least, cut - span)
        for m in _SAFE.finditer(text, at, min(len(text), cut + 2)):
            if m.start() <= cut:
                low = m.start()
        if low is None:
            if at == least:
                low = least
            span *= 8
    found = _SAFE.search(text, cut)
    return low, found.start() if found else len(text)


_codecs: dict[tuple[str, str, str], Codec] = {}


def codec(json_path: str, ranks_path: str, pattern: str) -> Codec:
    """One codec for each worker process, with its chunk cache."""
    key = (json_path, ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def routed(docs: DataFrame) -> DataFrame:
    """Documents with copies and near copies side by side, no partition much larger than the others."""
    key = F.pandas_udf(lambda s: s.map(route), "long")
    return texts(docs).withColumn("route", key(TEXT)).hint("rebalance", "route").select(DOC_ID, TEXT)


def encode(docs: DataFrame, vocabulary: tuple[str, str, str]) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``; a null text is read as empty, an empty text has no ids.

    ``vocabulary``: path of the tokenizers file, path of the same vocabulary as
    ranks, and its pattern. Equal to one whole-text encoding without special
    tokens added. Repeated rows stay repeated; ids are never cut or padded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*vocabulary)
        for batch in batches:
            parts = own.encode_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(parts)], names=[DOC_ID, "ids"])

    kind = docs.select(F.col(DOC_ID)).schema[0].dataType.simpleString()
    return routed(docs).mapInArrow(run, f"{DOC_ID} {kind}, ids array<int>")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def there_and_back(vocabulary: tuple[str, str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``encode_and_decode`` does in a task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*vocabulary)
        try:
            for batch in batches:
                parts = own.encode_all(batch.column(1).to_pylist())
                back = [own.decode(ids.tolist()) for ids in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(parts), pa.array(back, pa.string())], names=[DOC_ID, "ids", TEXT])
        finally:
            own.forget_chunks()

    return run


def encode_and_decode(docs: DataFrame, vocabulary: tuple[str, str, str]) -> DataFrame:
    """The rows of ``decode(encode(docs))``: doc_id, ids, and the text that the ids spell.

    A task has one worker instead of two, which holds one codec, and no chunks once
    the task has ended.
    """
    kind = docs.select(F.col(DOC_ID)).schema[0].dataType.simpleString()
    return routed(docs).mapInArrow(there_and_back(vocabulary), f"{DOC_ID} {kind}, ids array<int>, {TEXT} string")


def decode(encoded: DataFrame, vocabulary: tuple[str, str, str]) -> DataFrame:
    """``encoded`` with a column text that its column ids spell; a null list of ids gives an empty text."""

    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(*vocabulary)
        for ids in lists:
            yield ids.map(lambda x: "" if x is None else own.decode(x.tolist()))

    return encoded.withColumn(TEXT, F.pandas_udf(run, "string")("ids"))
