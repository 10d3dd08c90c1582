"""The engine's rules on hand-written rows."""

import io
import zipfile

import pytest

from lakewright.api import Lake
from lakewright.functions.documents import csv_rows, html_table_rows, json_bounds, select_records, zip_csv_rows
from lakewright.plans.dialect import expand
from lakewright.sources.lake import object_path, valid_key

OBS = "run_id string, entity_id string, entity_class string, property_id string, value string, source_id string, source_type string, authority_tier string, publisher_id string, confidence double, step long, value_id string"


def obs(spark, *rows):
    """Rows of (entity, class, property, value, source, tier, publisher, confidence)."""
    full = [("r", e, c, p, v, s, "t", tier, pub, conf, None, f"val:{i}") for i, (e, c, p, v, s, tier, pub, conf) in enumerate(rows)]
    return Lake(spark, obs=spark.createDataFrame(full, OBS))


def gold(lake):
    return {(r.entity_id, r.property_id): (r.value, r.status) for r in lake.relation("gold_fields").collect()}


def test_tier_beats_count(spark):
    rows = [("customer:1", "customer", "name", "a", s, "low", None, 0.9) for s in ("x", "y", "z")] + [("customer:1", "customer", "name", "b", "w", "primary", None, 0.1)]
    assert gold(obs(spark, *rows)) == {("customer:1", "name"): ("b", "conflict")}


def test_ties_end_in_text_order(spark):
    assert gold(obs(spark, ("customer:1", "customer", "name", "b", "x", "low", None, 0.5), ("customer:1", "customer", "name", "B", "y", "low", None, 0.5)))[("customer:1", "name")] == ("B", "conflict")


def test_publisher_falls_back_to_source(spark):
    lake = obs(spark, ("customer:1", "customer", "name", "a", "x", "low", None, 0.5), ("customer:1", "customer", "name", "a", "y", "low", "", 0.6), ("customer:1", "customer", "name", "a", "z", "low", "p", 0.7))
    assert {r.corroboration for r in lake.relation("corroborated").collect()} == {3}


def test_rejects_carry_the_first_reason(spark):
    lake = obs(spark, ("bad:1", "customer", "name", "a", "x", "low", None, 1.5), ("customer:1", "customer", "name", "a", "x", "low", None, 1.5), ("order:1", "order", "order_date", "1997-1-1", "x", "low", None, 0.5), ("order:1", "order", "order_key", "1", "x", "low", None, 0.5))
    assert [r.reason for r in lake.relation("obs_reasons").orderBy("value_id").collect()] == ["entity id has another class", "confidence is out of range", "value is no date", None]


def test_missing_is_materialised(spark):
    fields = obs(spark, ("supplier:1", "supplier", "name", "a", "x", "low", None, 0.5)).relation("fields").collect()
    assert {(r.property_id, r.status) for r in fields} == {("supplier_key", "missing"), ("name", "gold"), ("nation", "missing")}


def test_links_join_equal_values_and_carry_the_source_value(spark):
    lake = obs(spark, ("customer:1", "customer", "nation", "7", "x", "low", None, 0.5), ("supplier:2", "supplier", "nation", "7", "x", "low", None, 0.5), ("supplier:3", "supplier", "nation", "8", "x", "low", None, 0.5))
    assert [tuple(r) for r in lake.relation("gold_links").collect()] == [("same_nation", "customer:1", "supplier:2", "val:0")]


def test_conflicted_values_do_not_link(spark):
    lake = obs(spark, ("customer:1", "customer", "nation", "7", "x", "low", None, 0.5), ("customer:1", "customer", "nation", "8", "y", "low", None, 0.5), ("supplier:2", "supplier", "nation", "7", "x", "low", None, 0.5))
    assert lake.relation("gold_links").count() == 0


def test_shares_of_nothing_are_zero(spark):
    lake = obs(spark, ("supplier:2", "supplier", "nation", "7", "x", "low", None, 0.5))
    assert lake.relation("dod_7").first().actual == 0.0
    assert lake.relation("dod_9").first().actual == 0.0


def test_sibling_arrays_cross_and_shallowest_records_win():
    assert list(select_records('{"x": {"deep": [{"a": 1}]}, "top": [{"b": 2, "c": [1]}]}')) == [("/top", 1, ["b=2", "c=[1]"])]
    assert json_bounds('{"a": [1, {"b": 2}]}', depth=3) == (4, 5, False)


def test_tables_and_blocks():
    assert list(csv_rows("﻿a;b\n;\n1;2\n")) == [("csv", 1, ["a", "b"]), ("csv", 3, ["1", "2"])]
    assert html_table_rows("<table><tr><th>a<td>b</td></tr></table>")[0][0] == "html-table-1"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.csv", "x,y\n1,2\n")
        z.writestr("b.txt", "no")
    assert [r[2] for r in zip_csv_rows(data.getvalue())] == [["x", "y"], ["1", "2"]]
    with pytest.raises(ValueError, match="expands"):
        list(zip_csv_rows(data.getvalue(), limit=1))


def test_keys():
    assert valid_key("gold/r/x.json") and not valid_key("gold/../x") and not valid_key("sha256:12")
    assert object_path("/l", "sha256:" + "a" * 64) == "/l/bronze/sha256/" + "a" * 64


def test_macros_nest():
    assert expand("idiv(idiv(a, 2), key_of(p))", "duckdb") == "((a // 2) // CAST(json_extract_string(p, '$.k') AS BIGINT))"
