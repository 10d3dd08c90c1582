"""The stages hold against brute force, and the registered queries against the tables."""

import brute
import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lakewright.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        docs.write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((before, docs))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf, stages):
    original = spark.read.parquet(f"{sf}/documents.parquet")
    assert all(out.columns == original.columns for _, out in stages[:-1])
    before, after = stages[0]
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert all(marks.get(i, 1) for i in gone)
    before, after = stages[1]
    assert {i for i, _ in pairs(after)} == {c for _, c in brute.components(pairs(before)).values()}
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {i for i, _ in pairs(after)} == {i for i, w in brute.contamination(pairs(before), items).items() if not w[1]}
    before, after = stages[3]
    taken = {}
    for r in after.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert max(taken.values()) <= 3 and set(taken) <= {i for i, _ in pairs(before)}
    before, after = stages[4]
    ids, tokenizer = [], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for _, text in sorted(pairs(before)):
        ids.append(len(tokenizer.encode(text, add_special_tokens=False).ids) + 1)
    got = [r.n_tokens for r in after.orderBy("start").collect()]
    assert got == ids and [r.start for r in after.orderBy("start").collect()] == [sum(ids[:i]) for i in range(len(ids))]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, sf, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    want = connection.sql(ORACLE_SQL[name])
    place = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert sorted(str(tuple(r[c] for c in columns)) for r in frame.collect()) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())
