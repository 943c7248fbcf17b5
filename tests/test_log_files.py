"""Sealed logs written by Spark and read by their tails; growing logs read once, line by line."""

import gzip
import io
import json

import pytest
from pyspark.sql import functions as F

from chronolane import api
from chronolane.sources import growing, jsonl, sealed, stores, tails

WIRE = "log_id string, pos long, t_us long, frame long, signal string, key array<string>, value string, score double"


def wire(spark, logs, n=50):
    rows = [(log, i, i * 1000, i, "arm", ["1"], None if i % 7 == 0 else f'{{"digit":{i}}}', 0.5) for log in logs for i in range(n)]
    return spark.createDataFrame(rows, WIRE)


class Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.reads = []

    def read(self, n=-1):
        self.reads.append(n)
        return super().read(n)


def test_written_logs_are_read_by_head_and_tail(spark, tmp_path):
    logs = ["a/b", "c d", "ü%"]
    extras = [(log, sealed.APPENDIX, '{"intervals_version":1,"intervals":["x"]}') for log in logs[:2]] + [("c d", sealed.FOOTER, '{"summary_version":1,"summary":{}}')]
    where = str(tmp_path / "logs")
    jsonl.write_logs(wire(spark, logs, 20_000).repartition(3), where, spark.createDataFrame(extras, "log_id string, step int, line string"))
    files = stores.listed(where)
    assert len(files) == 3 and not list((tmp_path / "logs").glob("_open-*"))
    for file, size in files.items():
        data = open(file, "rb").read()
        lines = gzip.decompress(data).splitlines()
        told, source = tails.tail_sizes(data), Counted(data)
        assert sum(told) < 500 and lines[0] == b'{"log_version":1}' and json.loads(lines[-1])["observations"] == 20_000
        first, appendix, last = tails.edges(source, size, True)
        assert (first, last) == (lines[0], lines[-1]) and (appendix == lines[-2] if told[0] else appendix == b"")
        assert len(source.reads) == 2 and sum(source.reads) == min(size, tails.HEAD) + sum(told) < size
    states = sorted(r["state"] for r in api.inventory(spark, where).collect())
    assert states == ["complete", "outdated", "outdated"]
    back = jsonl.observations(jsonl.read_lines(spark, where)).where(F.col("log_id").contains("c%2520d") | F.col("log_id").contains("c%20d"))
    assert back.count() == 20_000 and back.where("value is null").count() == len(range(0, 20_000, 7))


def test_a_failed_job_leaves_no_log(spark, tmp_path):
    where = str(tmp_path / "logs")
    good = wire(spark, ["fine"])
    jsonl.write_logs(good, where)
    bad = wire(spark, ["x", "y"]).withColumn("value", F.when(F.col("pos") == 40, F.raise_error(F.lit("torn")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="torn"):
        jsonl.write_logs(bad, where)
    assert [f.rsplit("log_id=", 1)[1] for f in stores.listed(where)] == ["fine/log.gz"]
    with pytest.raises(ValueError, match="never overwritten"):
        sealed.SealedLogs({"path": where}).writer(None, True)


def test_extra_fields_of_any_gzip_header():
    assert tails.extra_fields(b"") == tails.extra_fields(b"\x1f\x8b\x08") == tails.extra_fields(gzip.compress(b"x")) == {}
    own = tails.member(b"x", b"AB\x02\x00xyCD\x00\x00" + tails.SUBFIELD + b"\x08\x00" + bytes(8))
    assert tails.extra_fields(own) == {b"AB": b"xy", b"CD": b"", tails.SUBFIELD: bytes(8)}
    assert tails.extra_fields(tails.member(b"x", b"AB\xff\xffxy")) == {} and tails.tail_sizes(tails.member(b"x", tails.SUBFIELD + b"\x02\x00xy")) is None


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_lines_belong_to_the_range_of_their_end(chunk):
    data = b"one\n\ntwo words\n  \n\xc3\xbc" + b"x" * 50 + b"\nlast without end"
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want += [(at, line)] if line.strip() else []
        at += len(line) + 1
    for step in (1, 2, 5, 17, 1000):
        got = [x for s in range(0, len(data), step) for x in growing.lines_between(io.BytesIO(data), s, min(s + step, len(data)), chunk)]
        assert got == want


def test_growing_files_are_read_once(spark, tmp_path):
    folder = tmp_path / "open"
    folder.mkdir()
    line = lambda i: json.dumps({"t": i / 10, "f": i, "s": "arm", "k": ["1"], "v": None, "c": 0.5}) + "\n"
    source = growing.read(spark, str(folder), range_bytes=100)
    parts = [
        {"a.jsonl": '{"log_version":1}\n' + line(1) + line(2)[:9]},
        {"a.jsonl": line(2)[9:] + line(3), "b.jsonl": line(4)[:-1]},
        {"b.jsonl": "\n", "c.txt": line(9), "_d.jsonl": line(9)},
        {},
        {"a.jsonl": "".join(map(line, range(10, 60)))},
    ]
    seen = []
    for n, part in enumerate(parts):
        for name, text in part.items():
            with (folder / name).open("a") as f:
                f.write(text)
        out = growing.observations(source)
        run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
        seen.append(sorted(r["frame"] for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen == [[1], [1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4, *range(10, 60)]]
    rows = spark.read.parquet(str(tmp_path / "out")).where("frame = 3").collect()
    assert [(r["pos"], r["t_us"]) for r in rows] == [(len('{"log_version":1}\n' + line(1) + line(2)), 300_000)]


def test_edges_of_files_are_those_of_all_their_lines_and_only_they_are_sorted(spark, tmp_path):
    from chronolane.sources import jsonl

    for name, n in (("a", 1), ("b", 2), ("c", 3), ("d", 500)):
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(f'{{"f":{i}}}' for i in range(n)) + "\n \n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        edges = jsonl.read_edges(spark, str(tmp_path))
        want = jsonl.edge_lines(jsonl.read_lines(spark, str(tmp_path)))
        assert sorted(map(repr, edges.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first = edges._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [x for x in first if "MapInArrow" in x or "Window" in x][-1].strip().find("MapInArrow") >= 0
