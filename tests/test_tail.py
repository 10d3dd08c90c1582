"""Tails of growing files: offsets, torn lines, restarts, truncation, rules of steps; overlays of records."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lakewright.sources import tail
from lakewright.streaming import tails


def step(session, number, **more):
    return json.dumps({"session_id": session, "step_id": f"{session}-{number}", "phase": 5, "mode": "S1", **more}, ensure_ascii=False)


def write(path, lines, torn="", mode="w"):
    with open(path, mode, encoding="utf-8") as out:
        out.write("".join(f"{line}\n" for line in lines) + torn)


def drained(spark, folder, tmp_path, **more):
    rows = tails.advance(tails.checked_steps(tails.read_lines(spark, str(folder)), **more), "update", str(tmp_path / "feed"))
    return sorted((r.step_id, r.at) for r in rows.collect())


def expected(folder):
    """(step_id, byte) of the whole lines of all files."""
    found = []
    for name in os.listdir(folder):
        data, at = (folder / name).read_bytes(), 0
        for line in data.split(b"\n")[:-1]:
            found.append((json.loads(line)["step_id"], at))
            at += len(line) + 1
    return sorted(found)


def test_appends_tears_and_restarts(spark, tmp_path):
    folder = tmp_path / "steps"
    folder.mkdir()
    r, held, whole = random.Random(4), {}, ""
    for turn in range(4):
        for k in range(turn + 2):
            lines = [step(f"s{k}", f"{turn}-{i}", note="é" * r.randrange(5)) for i in range(r.randrange(4))]
            whole = step(f"s{k}", f"{turn}-torn")
            cut = r.randrange(len(whole))
            # what was torn before is completed first
            write(folder / f"s{k}.jsonl", [held.pop(f"s{k}", None) or step(f"s{k}", f"{turn}-first"), *lines], torn=whole[:cut], mode="a")
            held[f"s{k}"] = whole[cut:]
        assert drained(spark, folder, tmp_path) == expected(folder)
    assert drained(spark, folder, tmp_path) == expected(folder)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_meet_at_lines(spark, tmp_path, split):
    lines = [f'{{"n":{i},"t":"{"ü" * (i % 9)}"}}' for i in range(60)] + [""]
    write(tmp_path / "a.jsonl", lines, torn='{"n":99')
    write(tmp_path / "b.jsonl", [])
    write(tmp_path / "c.txt", ["{}"])
    rows = tails.read_lines(spark, str(tmp_path), stream=False, split=split).collect()
    assert [r.line for r in sorted(rows, key=lambda r: r.at)] == lines
    data = (tmp_path / "a.jsonl").read_bytes()
    assert all(data[r.at :].startswith(r.line.encode() + b"\n") for r in rows)


def test_nothing_there(spark, tmp_path):
    assert tails.read_lines(spark, str(tmp_path / "none"), stream=False).count() == 0


@pytest.mark.parametrize("how", ["shorter", "gone"])
def test_truncation_fails(spark, tmp_path, how):
    folder = tmp_path / "steps"
    folder.mkdir()
    write(folder / "s1.jsonl", [step("s1", i) for i in range(5)])
    write(folder / "s2.jsonl", [step("s2", 0)])
    drained(spark, folder, tmp_path)
    if how == "shorter":
        write(folder / "s1.jsonl", [step("s1", 0)])
    else:
        (folder / "s1.jsonl").unlink()
    with pytest.raises(Exception, match="truncated"):
        drained(spark, folder, tmp_path)


@pytest.mark.parametrize(
    ("line", "why"),
    [
        ("[1]", "no JSON object"), ('{"session_id":', "no JSON object"), ("", "no JSON object"), (step("s2", 7), "another session"), (step("s1", 7, phase=4), "phase or mode"), (step("s1", 7, mode="D0"), "phase or mode"),
        (step("s1", 7, case="c2"), "another case"), (json.dumps({"session_id": "s1", "phase": 5, "mode": "S1", "case": "c1"}), "no step id"), (step("s1", 0, case="c1", note="other body"), "twice"), (step("s1", 0, case="c1"), "twice"),
    ],
)
def test_rules_of_steps(spark, tmp_path, line, why):
    folder = tmp_path / "steps"
    folder.mkdir()
    write(folder / "s1.jsonl", [step("s1", 0, case="c1")])
    drained(spark, folder, tmp_path, expected={"case": "c1"})
    write(folder / "s1.jsonl", [line], mode="a")
    with pytest.raises(Exception, match=why):
        drained(spark, folder, tmp_path, expected={"case": "c1"})


def test_parent_of_the_first_step(spark, tmp_path):
    folder = tmp_path / "steps"
    folder.mkdir()
    write(folder / "s1.jsonl", [step("s1", 0), step("s1", 1, parent_step_id="s1-0")])
    rows = tails.advance(tails.checked_steps(tails.read_lines(spark, str(folder)), parent="root"), "update", str(tmp_path / "feed"))
    assert {r.step_id: r.parent_step_id for r in rows.collect()} == {"s1-0": "root", "s1-1": "s1-0"}
    write(folder / "s2.jsonl", [step("s2", 0, parent_step_id="x")])
    with pytest.raises(Exception, match="is first and has a parent"):
        tails.advance(tails.checked_steps(tails.read_lines(spark, str(folder)), parent="root"), "update", str(tmp_path / "feed"))


def test_last_line_feed_far_from_the_end(tmp_path):
    from pyarrow import fs

    path = tmp_path / "a.jsonl"
    path.write_bytes(b"{}\n" + b"x" * 200_000)
    assert tail.whole_lines(fs.LocalFileSystem(), str(path), 200_003) == 3
    assert tail.whole_lines(fs.LocalFileSystem(), str(path), 2) == 0


def test_overlay(spark):
    records = [
        {"job_id": "a", "x": 1, "y": {"k": [1, 2]}}, {"job_id": "b", "x": "q\"\\é"}, {"job_id": "a", "x": None, "z": True}, {"x": 5}, {"job_id": "", "x": 6}, {"job_id": "b", "a.b": [], "x": 2.5}, {"job_id": "c"},
    ]
    want = {}
    for record in records:
        if record.get("job_id"):
            want[record["job_id"]] = {**want.get(record["job_id"], {}), **record}
    lines = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(20, "torn {"), (21, "[]"), (22, None)]
    rows = spark.createDataFrame(lines, "at long, line string").repartition(4)
    got = {r.job_id: json.loads(r.record) for r in tails.overlaid(tails.latest_fields(tails.fields_of(rows, "job_id", "line", "at"), "job_id"), "job_id").collect()}
    assert got == want


def test_reading_stops_at_a_torn_line(spark):
    rows = spark.createDataFrame([("f", 0, '{"a":1}'), ("f", 9, '{"a":'), ("f", 20, '{"a":3}'), ("g", 5, "x"), ("h", 0, '{"a":4}')], "file string, at long, line string")
    assert sorted((r.file, r.at) for r in tails.before_torn(rows).collect()) == [("f", 0), ("h", 0)]


def test_sessions_are_replaced_whole(spark, tmp_path):
    lines = spark.range(50).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("session"), F.col("id").alias("number"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    tails.write_sessions(lines, str(tmp_path / "x"), 20)
    torn = (tmp_path / "x" / "s1.jsonl").read_text()
    tails.write_sessions(lines, str(tmp_path / "x"))
    whole = (tmp_path / "x" / "s1.jsonl").read_text()
    assert whole.startswith(torn) and not torn.endswith("\n") and whole.split("\n")[:-1] == [f"line {i}" for i in range(1, 50, 3)]
    assert sorted(os.listdir(tmp_path / "x")) == ["s0.jsonl", "s1.jsonl", "s2.jsonl"]


def test_small_files_share_a_task(tmp_path):
    ends = {f"f{i:04d}": 10 for i in range(3000)} | {"g": 250}
    reader = tail._Lines({"path": str(tmp_path), "split": "100"})
    tasks = reader.ranges({"f0000": 4}, ends)
    # the start of the first file is read; ten files of ten bytes are a task, and the large file is cut
    assert len(tasks) < 310 and all(sum(r.hi - r.lo for r in t.ranges) <= 100 for t in tasks)
    read = [r for t in tasks for r in t.ranges]
    assert {(r.file, r.lo, r.hi) for r in read} == {("f0000", 4, 10)} | {(f"f{i:04d}", 0, 10) for i in range(1, 3000)} | {("g", 0, 100), ("g", 100, 200), ("g", 200, 250)} and len(read) == 3003
    assert max(len(t.ranges) for t in tail._Lines({"path": str(tmp_path)}).ranges({}, ends)) == tail.FILES


def test_overlay_keeps_no_state(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(tails, "shared_folder", lambda spark: str(tmp_path))
    plan = tails.record_overlay_stream(spark, sf)
    (feed,) = (tmp_path / "tails").iterdir()
    batches = sorted(f.name for f in (feed / "feed" / "rows").iterdir() if f.name.startswith("batch="))
    assert batches == ["batch=0", "batch=1"] and not (feed / "feed" / "checkpoint" / "state").exists()
    assert plan.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
