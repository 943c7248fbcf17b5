import os
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from chronolane.llm import hilbert_shards, media, registry, toxicity

from .helpers import SCHEMA, documents, rows, words


def test_store_and_read_back_any_bytes():
    data = [bytes(range(256)) * 16, b"\xff" * 640, os.urandom(6400), bytes(64)]
    files = media.encode_batch(data)
    assert files == media.encode_batch(data)
    videos = [media.parse_avi(f) for f in files]
    pictures = iter(media.decode_frames([x for v in videos for x in v.frames]))
    for d, v in zip(data, videos):
        assert b"".join(next(pictures).tobytes() for _ in v.frames)[: v.payload_bytes] == d and v.fps == 25
    for cut in (0, 7, 100, len(files[0]) // 2):
        media.decode_frames(media.parse_avi(files[0][:cut]).frames)
    assert media.decode_frames([b"", b"\xff\xd8\xff", b"no jpeg at all"]) == [None, None, None]
    bare = files[2].replace(b"idx1", b"junk")
    assert media.parse_avi(bare).frames == videos[2].frames


def test_lists_nested_without_end():
    nested = b""
    for _ in range(3000):
        nested = b"LIST" + (len(nested) + 4).to_bytes(4, "little") + b"abcd" + nested
    assert media.parse_avi(b"RIFF" + (len(nested) + 4).to_bytes(4, "little") + b"AVI " + nested).frames == []


def test_media_of_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert media.read(media.store(none)).count() == 0 and media.clip_rows(media.store(none)).count() == 0


def test_shots_are_found():
    dark, light = np.full((4, 64), 10, np.uint8), np.full((4, 64), 240, np.uint8)
    found = media.shots([dark] * 10 + [light] * 5 + [dark] * 3, 25)
    assert [(c["first_frame"], c["n_frames"]) for c in found] == [(0, 10), (10, 5), (15, 3)]
    assert found[1]["start_s"] == 0.4 and media.shots([], 25) == []


def test_media_columns(spark):
    docs = documents(spark)
    back = rows(media.read(media.store(docs)))
    want = Counter(str(r["doc_id"]) for r in rows(docs))
    assert Counter(str(r["doc_id"]) for r in back) == want
    texts = {str(r["doc_id"]): (r["text"] or "").encode() for r in rows(docs)}
    for r in back:
        t = texts[str(r["doc_id"])]
        assert r["payload"].rstrip(b"\0") == t.rstrip(b"\0") and len(r["payload"]) % 64 == 0 and r["n_bytes"] == len(t) and len(r["payload"]) >= 64
    assert media.clip_rows(media.store(docs)).count() >= len(back)
    assert media.read(media.store(docs).limit(1).withColumn("media", F.lit(None).cast("binary"))).first()["payload"] == b""


def test_curve_is_continuous():
    places = {}
    for x in range(8):
        for y in range(8):
            for z in range(8):
                h = s = 0
                for b in (2, 1, 0):
                    d, s = hilbert_shards._TABLE[s * 8 + ((x >> b & 1) | (y >> b & 1) << 1 | (z >> b & 1) << 2)]
                    h = h * 8 + d
                places[h] = (x, y, z)
    assert len(places) == 512 and all(sum(abs(a - b) for a, b in zip(places[i], places[i + 1])) == 1 for i in range(511))


def test_shards_keep_the_law_of_rows(spark):
    docs = documents(spark)
    data = rows(hilbert_shards.shards(docs, 7))
    assert len(data) == docs.count()
    counts = Counter(r["shard"] for r in data)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in data if r["shard"] == s) == list(range(counts[s]))
    texts = {str(r["doc_id"]): (r["text"] or "").encode() for r in rows(docs)}
    assert all(r["size"] == len(texts[str(r["doc_id"])]) + 16 and r["text_crc32"] == zlib.crc32(texts[str(r["doc_id"])]) for r in data)
    order = [r["cell"] for r in sorted(data, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    assert sorted(r["shard"] for r in rows(hilbert_shards.shards(docs.limit(3), 7))) in ([0, 2, 4], [0, 2, 5], [0, 3, 5])
    assert hilbert_shards.shards(spark.createDataFrame([], SCHEMA), 7).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = kept
        kept = corpus_pipeline.written(stage(spark, kept, sf_dir))
        assert kept.columns == docs.columns and kept.count() <= before.count()
        if i == 0:
            model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~registry.held_out()))
            assert {r["doc_id"] for r in rows(toxicity.score(docs, model)) if r["score"] < 0.5} == {r["doc_id"] for r in rows(kept.select("doc_id"))}
    ids = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r["doc_id"] for r in rows(ids)} == {r["doc_id"] for r in rows(kept.select("doc_id"))}
    odd = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = corpus_pipeline.written(stage(spark, odd, sf_dir))
    assert odd.where("doc_id is null").count() == 1


def test_queries_run_on_the_smallest_tables(spark, sf_dir):
    for name, query in registry.queries().items():
        assert query(spark, sf_dir).columns, name


def test_texts_that_share_an_id_are_told_apart(spark):
    import random

    import corpus_pipeline

    rnd = random.Random(8)
    a, b, c = (words(rnd, 120) for _ in range(3))
    rows_ = [(1, a), (2, a + " more"), (2, b), (2, b), (3, b + " again"), (4, c), (None, a), (5, None), (6, ""), (4, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows_], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()), key=repr)
    assert kept == sorted([(1, a), (2, b), (4, c), (None, a), (5, None)], key=repr)
    assert corpus_pipeline.without_near_copies(spark, docs.limit(0), "").count() == 0
