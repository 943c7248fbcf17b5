"""What is kept between scans: inventories by name, time and size, intervals by version; graphs and tokens of whole tables."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from chronolane import api
from chronolane.operators import archive, catalog, graph
from chronolane.sources import tails

HEAD = json.dumps({"log_version": 1}).encode()
POD = {"x": 1, "y": 2, "w": 3, "h": 4}
LAYOUT = {"type": "geometry", "pods": [{"column": 1, "role": "camera", "box": POD}]}


def body(n):
    return b"".join(json.dumps({"t": float(i), "f": i, "s": "layout", "k": [], "v": LAYOUT, "c": 1.0}).encode() + b"\n" for i in range(n))


def sealed(path, n, appendix=None):
    path.write_bytes(tails.packed(HEAD, body(n), appendix, json.dumps({"observations": n, "summary_version": 1, "summary": {}}).encode()))


def test_inventory_opens_changed_files_only(spark, tmp_path, monkeypatch):
    logs, memory = tmp_path / "logs", str(tmp_path / "memory")
    logs.mkdir()
    for name in ("a b.gz", "b.gz", "c.gz"):
        sealed(logs / name, 2)
    opened = []
    monkeypatch.setattr(tails, "edge_lines", lambda files, by_content=False, f=tails.edge_lines: (opened.append(sorted(r["name"].rsplit("/", 1)[1] for r in files.collect())), f(files, by_content))[1])

    def scan():
        got = {r["name"].rsplit("/", 1)[1]: r["footer"]["observations"] for r in api.remembered_inventory(spark, str(logs), memory).collect()}
        return got, opened[-1]

    assert scan() == ({"a b.gz": 2, "b.gz": 2, "c.gz": 2}, ["a b.gz", "b.gz", "c.gz"])
    assert scan() == ({"a b.gz": 2, "b.gz": 2, "c.gz": 2}, [])
    sealed(logs / "b.gz", 3)  # another size
    os.utime(logs / "c.gz", (1, 1))  # another time
    (logs / "a b.gz").unlink()
    assert scan() == ({"b.gz": 3, "c.gz": 2}, ["b.gz", "c.gz"])
    assert len(os.listdir(memory)) == 2


def test_intervals_are_derived_once(spark, tmp_path):
    logs, memory = tmp_path / "logs", tmp_path / "memory"
    logs.mkdir()
    run = {"lane": "laser", "arm": 1, "col": 2, "start_us": 5, "end_us": 9, "v": None}
    sealed(logs / "own.gz", 2, json.dumps({"intervals_version": 1, "intervals": [run]}).encode())
    sealed(logs / "none.gz", 2, b'{"intervals_version":1,"intervals":[]}')
    sealed(logs / "old one.gz", 3, b'{"intervals_version":0,"intervals":[]}')
    (logs / "open+.jsonl").write_bytes(HEAD + b"\n" + body(2))
    actions = spark.createDataFrame([], "alias string, color string, labels array<string>")

    def got():
        return sorted((r["name"].rsplit("/", 1)[1], r["lane"], r["start_us"], r["end_us"]) for r in api.intervals(spark, str(logs), actions, str(memory)).collect())

    want = [("old one.gz", "role", 0, 3_000_000), ("open+.jsonl", "role", 0, 2_000_000), ("own.gz", "laser", 5, 9)]
    assert got() == want
    snapshots = sorted(os.listdir(memory))
    assert got() == want and sorted(os.listdir(memory)) == snapshots  # nothing was derived again
    with (logs / "open+.jsonl").open("ab") as f:
        f.write(json.dumps({"t": 2.0, "f": 2, "s": "layout", "k": [], "v": None, "c": 0.0}).encode() + b"\n")
    assert got() == [want[0], ("open+.jsonl", "no_ui", 2_000_000, 3_000_000), ("open+.jsonl", "role", 0, 2_000_000), want[2]]
    assert sorted(os.listdir(memory)) != snapshots


def test_graph_of_any_depth_and_cycles(spark):
    edges = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 12)] + [("5", "0"), ("5", "4"), ("x", "lost")], "node string, needs string")
    reach = {(str(i), str(j)) for i in range(12) for j in range(i)} | {("x", "lost")}
    assert {tuple(r) for r in graph.closure(edges).collect()} == reach and graph.closure(edges).count() == len(reach)
    nodes = spark.createDataFrame([(str(i),) for i in range(12)] + [("x",)], "node string")
    assert {r["node"]: r["level"] for r in graph.levels(nodes, edges).collect()} == {**{str(i): i for i in range(12)}, "x": 0}
    turn = edges.union(spark.createDataFrame([("0", "7")], "node string, needs string"))
    for f in (lambda: graph.closure(turn), lambda: graph.levels(nodes, turn)):
        with pytest.raises(ValueError, match="cycle"):
            f()
    none = edges.limit(0)
    assert graph.closure(none).count() == 0 and graph.levels(none.select("node"), none).count() == 0


def test_tokens_of_a_column_equal_tokenize(spark):
    rnd = random.Random(3)
    parts = ["name:", "NAME:", "nope:", "text: ", '"', " ", "  ", "a", "b:c", "ü", 'x"y', "\t", "popup:"]
    asked = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))).strip(" ") for _ in range(400)]
    asked = [a for a in asked if a == a.strip()]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, q string")
    got = {r["i"]: [(x["field"], x["token"]) for x in r["t"]] for r in df.select("i", archive.tokens(F.col("q")).alias("t")).collect()}
    assert got == {i: archive.tokenize(a) for i, a in enumerate(asked)}


def test_contested_aliases_are_refused(spark):
    rows = spark.createDataFrame([("A",)], "text string")
    fine = spark.createDataFrame([(1, "a"), (1, "A"), (2, "b")], "entry_id int, alias string")
    assert catalog.resolve(rows, "text", fine).first()["entry_id"] == 1
    with pytest.raises(ValueError, match="a"):
        catalog.resolve(rows, "text", fine.union(spark.createDataFrame([(3, "a")], "entry_id int, alias string")))
