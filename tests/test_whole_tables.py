"""Queries read whole tables: no range or residue of ids, no prefix of texts."""

import pytest

from lakewright.plans import dialect, registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def tables(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")


def test_every_row_is_there(spark, sf, tables):
    lines = tables("lineitem").join(tables("orders").selectExpr("o_orderkey AS l_orderkey"), "l_orderkey").count()
    assert QUERIES["canonical_json"](spark, sf).count() == tables("events").count() > 500
    assert QUERIES["date_before"](spark, sf).count() == lines
    assert QUERIES["json_flatten_cross"](spark, sf).count() == 2 * lines


def test_symmetric_links_are_those_of_all_pairs(spark, sf):
    values = [(r.value, r.entity_id) for r in dialect.frame(spark, sf, "present").where("property_id = 'segment'").collect()]
    want = {(a, b) for v, a in values for w, b in values if v == w and a != b}
    got = QUERIES["relation_symmetric"](spark, sf).collect()
    assert {(a.member, b.member) for a in got for b in got if a.segment == b.segment and a.member != b.member} == want
    assert len(want) == sum(r.links for r in got) and any(len(a) > 11 for a, _ in want)


def test_crawl_reaches_hosts_beyond_the_first_pages(spark, tmp_path):
    # page 0 links to page 1, page 1 to page 8, and page 8 to page 57
    spark.createDataFrame([(i, f"http://h{0 if i == 0 else 1 if i in (1, 8) else i}.x/") for i in range(60)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.host: r.depth for r in QUERIES["crawl_bfs"](spark, str(tmp_path)).collect()}
    assert got == {"h0.x": 0, "h1.x": 1, "h57.x": 2}


def test_texts_are_read_whole(spark, sf, tmp_path):
    long = "Same opening " * 40
    spark.createDataFrame([(1, long + "A", "en", "s"), (2, long + "B", "de", "s"), (3, long + "A", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.identifier[-3:] for r in QUERIES["normalize_identifier"](spark, str(tmp_path)).collect()} == {1: "g a", 2: "g b", 3: "g a"}
    assert sorted(r.n for r in QUERIES["cache_hit_split"](spark, str(tmp_path)).collect()) == [1, 2]
