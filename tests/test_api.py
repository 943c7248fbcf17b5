"""The wire format end to end: a small log through corrections, lanes, summary, screening and masking."""

import json

import pytest
from pyspark.sql import functions as F

from chronolane import api
from chronolane.sources import jsonl, tails

POD = {"x": 1, "y": 2, "w": 3, "h": 4}


def _layout(boxes=True):
    return {"type": "geometry", "pods": [{"column": 1, "role": "camera", "box": POD}, {"column": 2, "role": "instrument", **({"box": POD} if boxes else {})}]}


@pytest.fixture()
def log(spark, tmp_path):
    def press(on):
        return {"type": "press", "pressed": on}

    def popup(*texts):
        return {"type": "popups", "messages": [{"text": t, "box": POD} for t in texts]}

    rows = [
        (1.0, 1, "pedals", ["2", "blue"], press(True)),  # no layout yet: no_ui, and no instrument held: released
        (2.0, 2, "layout", [], _layout()),
        (2.0, 2, "arm", ["2"], {"type": "digit", "digit": 4}),
        (2.0, 2, "instrument", ["2"], {"type": "instrument", "name": "Grasper", "match": 99, "raw": "grasper", "window": "wide"}),
        (3.0, 3, "arm", ["2"], {"type": "digit", "digit": 4}),
        (3.0, 3, "pedals", ["2", "blue"], press(True)),
        (3.0, 3, "popups", ["1"], popup("sent by ann: please come to the office", "hello")),
        (4.0, 4, "popups", ["1"], popup("hello")),
        (4.0, 4, "pedals", ["2", "blue"], press(False)),
        (5.0, 5, "layout", [], None),
        (6.0, 6, "layout", [], _layout()),
        (6.0, 6, "offscreen", [], {"type": "offscreen", "bars": [{"score": 1, "status": "a", "arm": 3}, {"score": 1, "status": "b", "arm": 3}]}),
    ]
    wire = [json.dumps({"log_version": 1})] + [json.dumps({"t": t, "f": f, "s": s, "k": k, "v": v, "c": 1.0}) for t, f, s, k, v in rows]
    (tmp_path / "case.jsonl").write_text("\n".join(wire) + "\n")
    return api.load(spark, str(tmp_path))


@pytest.fixture()
def actions(spark):
    return spark.createDataFrame([("grasper", "blue", ["cut", "seal"]), ("grasper", "yellow", []), ("scope", "blue", ["zoom"])], "alias string, color string, labels array<string>")


def _runs(df):
    return sorted((r["lane"], r["arm"] or 0, r["col"] or 0, r["start_us"] / 1e6, r["end_us"] / 1e6, r["v"]) for r in df.collect())


def test_intervals_and_summary(log, actions):
    got = _runs(api.interval_view(api.corrected(log, actions), actions))
    assert ("no_ui", 0, 0, 1.0, 2.0, None) in got and ("no_ui", 0, 0, 5.0, 6.0, None) in got
    assert ("role", 1, 1, 2.0, 5.0, "camera") in got and ("role", 1, 1, 6.0, 7.0, "camera") in got
    assert ("instrument", 4, 2, 2.0, 5.0, "Grasper") in got
    assert [r for r in got if r[0] == "pedal_blue"] == [("pedal_blue", 4, 2, 3.0, 4.0, None)]
    assert ("offscreen", 3, 0, 6.0, 7.0, "b") in got
    assert ("popup", 1, 1, 3.0, 5.0, "hello") in got
    row = api.summary_view(api.corrected(log, actions), actions).first()
    assert (row["pedal_blue_count"], row["pedal_blue_us"], row["no_ui_us"], row["mounts"], row["changes"]) == (1, 1_000_000, 2_000_000, 1, 0)


def test_screen_and_mask(spark, log, actions):
    templates = spark.createDataFrame([("sent", 0, "please come to the office")], "template_id string, ord int, tail string")
    found = [(r["hit_id"], r["start_us"] / 1e6, r["end_us"] / 1e6) for r in api.screen(log, templates).collect()]
    assert found == [("sent", 2.0, 5.0)]
    texts = {r["v"] for r in api.interval_view(api.masked(log, templates), actions).where("lane = 'popup'").collect()}
    assert texts == {"masked:sent", "hello"}


def test_states_and_inventory(spark, log, tmp_path):
    at = log.groupBy("log_id").agg({"t_us": "max"}).withColumnRenamed("max(t_us)", "at_us")
    held = {(r["signal"], tuple(r["key"])) for r in api.state_at(log, at).collect()}
    assert ("arm", ("2",)) in held and ("layout", ()) in held
    assert api.fresh_at(log, at).count() == 2 and api.frame_view(log).count() == 6
    assert [r["state"] for r in api.inventory(spark, str(tmp_path)).collect()] == ["running"]
    assert jsonl.broken(jsonl.read_lines(spark, str(tmp_path))).count() == 0


def test_command_line(log, tmp_path, capsys):
    from chronolane.__main__ import main, parser

    assert main(["query", str(tmp_path), "--at", "0:03", "--show", "fresh"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert sorted(r["signal"] for r in rows) == ["arm", "pedals", "popups"]
    assert main(["query", str(tmp_path), "--at", "3", "--show", "lanes"]) == 0
    assert "instrument" in {json.loads(x)["lane"] for x in capsys.readouterr().out.splitlines()}
    assert main(["search", str(tmp_path), "name:case"]) == 0 and '"state":"running"' in capsys.readouterr().out
    (tmp_path / "entries.json").write_text('[{"name": "b", "type": "x"}, {"name": "a", "type": "x"}]')
    assert main(["catalog", str(tmp_path / "entries.json")]) == 0
    assert [json.loads(x)["name"] for x in capsys.readouterr().out.splitlines()] == ["a", "b"]
    assert main(["catalog", str(tmp_path / "entries.json"), "--table"]) == 0
    assert capsys.readouterr().out.splitlines() == ["name  type", "────  ────", "a     x", "b     x"]
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing"])


def test_inventory_of_sealed_logs(spark, tmp_path):
    from chronolane.model import LOG_VERSION, SUMMARY_VERSION

    video = {"filename": "v.mp4", "width": 1, "height": 1, "codec": "x", "duration_s": 8.0}
    head = json.dumps({"log_version": LOG_VERSION, "video": video, "engines": {"catalog": {"used_by": ["instrument"], "locale": "de"}}}).encode()
    summary = {"instruments": [{"name": "Grasper", "type": "tool"}], "presses_by_action": {"Seal": 1}, "popup_texts": ["hello there"], "banner_texts": []}
    for name, version in (("new", SUMMARY_VERSION), ("old", SUMMARY_VERSION - 1)):
        foot = json.dumps({"observations": 1, "frames_sampled": 1, "achieved_fps": 1.0, "runtime_s": 2.0, "summary_version": version, "summary": summary}).encode()
        (tmp_path / f"{name}.gz").write_bytes(tails.packed(head, b'{"t":1.0,"f":1,"s":"arm","k":["2"],"v":null,"c":0.5}\n', b'{"intervals_version":1,"intervals":[]}', foot))
    (tmp_path / "open.jsonl").write_bytes(head + b'\n{"t":2.0,"f":1,"s":"arm","k":["2"],"v":null,"c":0.5}\n{"t":3.')
    for whole in (False, True):
        got = {r["name"].rsplit("/", 1)[1]: r for r in api.inventory(spark, str(tmp_path), whole).collect()}
        assert {k: (r["state"], r["locale"], r["progress"]) for k, r in got.items()} == {"new.gz": ("complete", "de", None), "old.gz": ("outdated", "de", None), "open.jsonl": ("running", "de", None)}
        assert got["new.gz"]["footer"]["runtime_s"] == 2.0 and got["old.gz"]["summary"] is None
    entries = api.inventory(spark, str(tmp_path))
    found = lambda words: {r["name"].rsplit("/", 1)[1] for r in api.search(entries, words, api.corpus()).collect()}
    assert found("instrument:grasper action:seal") == {"new.gz"} and found("popup:hello") == {"new.gz"} and found("name:open") == {"open.jsonl"}
    (tmp_path / "other.jsonl").write_text('{"log_version":99}\n')
    with pytest.raises(Exception, match="log version"):
        api.inventory(spark, str(tmp_path)).collect()
    assert spark.sql("select 'a/../b' x union all select '/a' union all select '' union all select 'a/b'").where(jsonl.confined(F.col("x"))).count() == 1
