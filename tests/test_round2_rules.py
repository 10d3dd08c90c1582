"""Chains, breadth-first depths, JSON records, profiles and contracts on hand-written rows and against plain Python."""

import json
import random

import pytest

from lakewright.functions import json_records as jr
from lakewright.functions import profiler
from lakewright.operators.chains import ancestors, breadth_first
from lakewright.plans.dialect import run_sql


def test_ancestors_of_long_chains_cycles_and_gaps(spark):
    up = {i: i - 1 for i in range(1, 300)} | {0: None, 1000: 1001, 1001: 1002, 1002: 1000, 1003: 1000, 2000: 999999, 2001: 2000, 3000: 3000}
    marks = {5: "a", 250: "b", 1001: "c"}
    steps = spark.createDataFrame([(n, p, marks.get(n)) for n, p in up.items()], "node long, up long, mark string")
    for r in ancestors(steps).collect():
        seen, at, own, broken = {r.node}, up[r.node], set(), False
        while at is not None:
            if at in seen or at not in up:
                broken = True
                break
            seen.add(at)
            own |= {marks[at]} if at in marks else set()
            at = up[at]
        assert r.broken == broken
        if not broken:
            assert (r.above, r.low, set(r.marks)) == (len(seen) - 1, min(seen), own), r.node


def test_breadth_first_depths(spark):
    r = random.Random(1)
    edges = [(s, r.randrange(60), r.randrange(60)) for s in "xy" for _ in range(90)]
    got = {(x.space, x.node): x.depth for x in breadth_first(spark.createDataFrame(edges, "space string, a long, b long"), spark.createDataFrame([("x", 0), ("y", 3)], "space string, node long")).collect()}
    want, frontier = {("x", 0): 0, ("y", 3): 0}, [("x", 0), ("y", 3)]
    while frontier:
        near = {(s, b) for s, a, b in edges for t, n in frontier if s == t and a == n} - set(want)
        depth = max(want.values()) + 1
        want |= dict.fromkeys(near, depth)
        frontier = list(near)
    assert got == want


def test_quarantine_fails_closed(spark):
    from lakewright.plans import registry

    rows = [(1, None, None, "view", "s"), (2, 1, "hard_stop", "view", "s"), (3, 2, None, "signup", "s"), (4, 2, None, "signup", "t"), (5, 99, None, "signup", "s"), (6, 7, None, "signup", "s"), (7, 6, None, "signup", "s"), (8, 1, "hard_stop", "signup", "s"), (9, 2, None, "signup", None)]
    chain = spark.createDataFrame(rows, "event_id long, parent_id long, event string, event_type string, source_id string")
    from pyspark.sql import functions as F

    state = ancestors(chain.select(F.col("event_id").alias("node"), F.col("parent_id").alias("up"), F.when(F.col("event") == "hard_stop", F.col("source_id")).alias("mark")))
    got = {x.node: x.broken or "s" in x.marks for x in state.collect()}
    assert {i: got[i] for i in (3, 5, 6, 7, 8)} == {3: True, 5: True, 6: True, 7: True, 8: False}
    assert "quarantine_ancestor" in registry.queries()


@pytest.mark.parametrize(("document", "rows"), [
    ({"a": 1, "b": {"c": None}}, [{"a": "1", "b.c": None}]),
    ({"a": [{"x": 1}, {"x": 2}], "b": [{"y": "p"}, {"y": "q"}]}, [{"a.x": "1", "b.y": "p"}, {"a.x": "1", "b.y": "q"}, {"a.x": "2", "b.y": "p"}, {"a.x": "2", "b.y": "q"}]),
    ({"a": [], "b": [1, {"c": 2}]}, [{"a": "[]", "b": '[1,{"c":2}]'}]),
    ([{"a": 1}, {"b": 2}], [{"a": "1"}, {"b": "2"}]),
    ({}, [{}]), (5, [{}]),
])
def test_cross_records(document, rows):
    assert jr.cross_records(document) == rows


def test_json_bounds_pointers_and_bad_texts(spark):
    with pytest.raises(jr.Beyond):
        jr.cross_records({k: [{"x": i} for i in range(50)] for k in "abc"})
    assert jr.flat_record({"a": {"b": [1, "é"]}, "c": "t"}) == {"a.b": '[1,"é"]', "c": "t"}
    document = {"a/b": {"~": [10, {"x": 1}]}, "e": {}}
    assert list(jr.leaves(document)) == [("/a~1b/~0/0", "10"), ("/a~1b/~0/1/x", "1"), ("/e", "{}")]
    assert jr.pointed(document, "/a~1b/~0/*") == [("/a~1b/~0/0", "10"), ("/a~1b/~0/1", '{"x":1}')]
    assert jr.pointed(document, "/a~1b/~0/7") == jr.pointed(document, "/no") == [] and len(jr.pointed(document, "")) == 1
    docs = spark.createDataFrame([(1, json.dumps(document)), (2, "{torn"), (3, None), (4, "[" * 100_000), (5, '{"a":' * 80 + "1" + "}" * 80)], "k long, t string")
    found = jr.each(docs, "k", "t", lambda d: [(json.dumps(r),) for r in jr.cross_records(d)], "r string").collect()
    assert {x.k: x.error for x in found} == {1: None, 2: "json", 3: "json", 4: "json", 5: "depth"}


def cells(spark, sheets):
    rows = [(s, i, j, c) for s, table in sheets.items() for i, row in enumerate(table) for j, c in enumerate(row)]
    return spark.createDataFrame(rows, "sheet string, row long, col int, cell string")


def test_profiles_of_sheets(spark):
    sheets = {
        "titled": [["Report 2024", None, None], ["Name", "Tax", ""], [" Ana  B ", "12-3456789", "1,200.50"], ["Bo", "", "7"], ["Name", "Tax", ""], ["Ana B", "98-7654321", ""], [None, "", " "]],
        "totals": [["Label", "Total"], *[[f"group {i}", f"{i}.5"] for i in range(12)]],
        "empty": [[None, ""]], "one": [["only"], ["x"], ["x"]],
    }
    frame = cells(spark, sheets)
    assert {r.sheet: r.header for r in profiler.header_rows(frame).collect()} == {"titled": 1, "totals": 0, "empty": 0, "one": 0}
    got = {(r.sheet, r.col): r for r in profiler.columns(frame, ("US",), {"yes": "^x$"}).collect()}
    name, tax, third = (got["titled", i] for i in range(3))
    assert (name.rows, name.fill_rate, name.distinct_values, name.is_unique, name.max_repeat, name.samples) == (3, 1.0, 2, False, 2, ["Ana B", "Bo"])
    assert (tax.dominant_pattern, tax.dominant_share, tax.fill_rate) == ("phone", 1.0, 0.6667) or tax.dominant_pattern == "tax_id_us_ein"
    assert third.name == "column_3" and third.dominant_pattern == "amount"
    assert got["one", 0].dominant_pattern == "yes" and got["one", 0].max_repeat == 2
    verdicts = {r.sheet: r.granularity for r in profiler.sheets(profiler.columns(frame)).collect()}
    assert verdicts["titled"] == "entity" and verdicts["totals"] == "aggregate" and "empty" not in verdicts
    again = {r.sheet: r.fingerprint for r in profiler.sheets(profiler.columns(frame)).collect()}
    assert again == {r.sheet: r.fingerprint for r in profiler.sheets(profiler.columns(frame)).collect()} and len(set(again.values())) == len(again)


def test_burn_rate_of_short_long_and_unpriced_runs(spark):
    hour = 3_600_000_000
    rows = [("a", 0, 1.0), ("a", hour // 2, 2.0), ("b", 0, 9.0), ("b", 2 * hour, 0.5), ("b", 3 * hour, 0.25), ("c", 0, None), ("c", hour, None), ("d", 5, 1.0)]
    trace = spark.createDataFrame(rows, "run_id string, us long, est_usd double")
    sql = "SELECT run_id, priced, usd, hours FROM run_burn"
    got = {r.run_id: (r.priced, r.usd, r.hours) for r in run_sql(spark, None, sql, {"trace": trace}).collect()}
    assert got == {"a": (2, 3.0, 0.5), "b": (2, 0.75, 1.0), "c": (0, None, 1.0), "d": (1, 1.0, 0.0)}
