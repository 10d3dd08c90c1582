"""Links by value hub against the SQL that lists pairs, on odd tables; work that grows with the tables and not with the pairs."""

import datetime
import os

import duckdb
import pytest

from lakewright.operators import hubs
from lakewright.plans import dialect, registry
from tests.test_queries import plain

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
N = 300


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """One nation of N customers and N suppliers; rows without keys or values, repeated rows, rows that contradict each other."""
    folder = str(tmp_path_factory.mktemp("odd"))
    day = lambda i: datetime.datetime(1997, 1, 1) + datetime.timedelta(days=i % 60)
    customers = [(i, f"c{i}", 7, "AUTO") for i in range(N)]
    customers += [(3, "c3", 8, "AUTO"), (4, "c4", 7, "BIKE"), (4, "c4", 7, "BIKE"), (None, "x", 7, "AUTO"), (N, None, 7, None), (N + 1, "y", None, "AUTO"), (N + 2, "z", 9, "AUTO"), (7, "c7", 7, "AUTO")]
    suppliers = [(i, f"s{i}", 7) for i in range(N)] + [(5, "s5", 8), (6, "s6", 7), (None, "t", 7), (N, "u", None), (N + 1, "v", 11), (11, "w", 11)]
    orders = [(i, i * 7 % (N + 9), "FOP"[i % 3], day(i), f"{i % 5}-X") for i in range(400)]
    orders += [(5, 12, "F", day(5), "1-X"), (6, 42, "P", day(6), "1-X"), (None, 1, "O", day(1), "2-X"), (401, None, "O", day(2), "2-X"), (402, 1, None, None, None), (1111, 1, "F", day(4), "4-X"), (2222, 1, "O", day(4), "3-X")]
    lines = [(i % 380, day(i * 5)) for i in range(900)] + [(None, day(1)), (390, None), (1111, day(3))]
    tables = {
        "customer": (customers, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"), "supplier": (suppliers, "s_suppkey long, s_name string, s_nationkey int"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"), "lineitem": (lines, "l_orderkey long, l_shipdate timestamp"), "events": ([(i,) for i in range(97)], "event_id long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def duck(odd):
    connection = duckdb.connect()
    for name in os.listdir(odd):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{odd}/{name}/*.parquet'")
    return connection


def rows_made(frame, kinds=""):
    """The most rows that an operator of a frame's plan makes, of those with kinds in their name; the frame is run."""
    frame.write.format("noop").mode("overwrite").save()
    execution = frame._jdf.queryExecution()
    top = execution.executedPlan()
    top.execute().count()
    todo, most = [top], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        found = node.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() and kinds in kind else 0)
    return most


def agrees(spark, duck, odd, name):
    frame = QUERIES[name](spark, odd)
    columns = sorted(frame.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    place = [result.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in place) for r in result.fetchall())
    return frame


@pytest.mark.parametrize("name", ["graph_bfs", "graph_degree", "graph_node_cap", "graph_context", "links_verify", "signal_counts"])
def test_no_pairs_are_listed(spark, duck, odd, name):
    frame = agrees(spark, duck, odd, name)
    assert rows_made(frame) < 20 * N < N * N


@pytest.mark.parametrize("name", ["dod_gaps", "dod_compare", "dod_coverage"])
def test_criteria_come_from_one_row(spark, duck, odd, name):
    assert rows_made(agrees(spark, duck, odd, name)) < 40


def test_all_criteria_agree(spark, duck, odd):
    key = lambda r: (r[0], r[1], r[2], float(r[3]), round(float(r[4]), 9))
    got = sorted(key(r) for r in dialect.run_sql(spark, odd, "SELECT criterion_id, query, operator, target, actual FROM profile_results").collect())
    assert got == sorted(key(r) for r in duck.sql(dialect.render("SELECT criterion_id, query, operator, target, actual FROM dod_results", "duckdb")).fetchall()) and len({r[4] for r in got}) > 5


@pytest.mark.parametrize("wide", [hubs.WIDE, 8])
def test_pairs_are_not_made_distinct(spark, duck, odd, wide, monkeypatch):
    monkeypatch.setitem(dialect._relations, "wide_hubs", dialect._relations["wide_hubs"].replace(f"> {hubs.WIDE}", f"> {wide}"))
    frame = agrees(spark, duck, odd, "relation_links")
    assert rows_made(frame, "Aggregate") < 20 * N < rows_made(frame)


def test_fields_are_chosen_without_windows(spark, duck, odd):
    assert "Window" not in agrees(spark, duck, odd, "entity_page")._jdf.queryExecution().executedPlan().toString()


def test_no_pair_is_there_twice(spark):
    """What hubs count by: END_PROPERTIES are the properties of the relations, and far ends of a class are of other classes."""
    specs = dialect.run_sql(spark, None, "SELECT * FROM relation_specs").collect()
    assert {p for s in specs for p in (s.domain_prop, s.range_prop)} == set(hubs.END_PROPERTIES)
    ends = {e for s in specs for e in ((s.domain_class, s.domain_prop, s.range_class, s.range_prop), (s.range_class, s.range_prop, s.domain_class, s.domain_prop))}
    assert all(near != far for near, _, far, _ in ends) and len({(near, far) for near, _, far, _ in ends}) == len(ends)
