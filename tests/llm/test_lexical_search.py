"""Ranked search against a plain scorer, on odd tables, in many shards and rounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lakewright.llm import common, lexical_search
from lakewright.llm import lexical_search as search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(d, Counter(t), len(t)) for d, x in docs if (t := terms(x))]
    count, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items if t is not None}:
        query, scores = Counter(terms(text)), []
        for d, c, n in held:
            m = 75 + 25 * n * count // words
            score = sum(times * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in query.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item_id, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def corpus(seed=1, count=300):
    r = random.Random(seed)
    pools = [[f"p{g}w{i}" for i in range(60)] for g in range(4)]
    rows = []
    for i in range(count):
        pool = pools[i % 4] + [f"c{j}" for j in range(20)]
        rows.append((i * 3, " ".join(r.choice(pool) for _ in range(r.randrange(1, 60)))))
    shared = "Common passage of several Words p0w1 p0w2"
    rows += [(5000 + i, shared) for i in range(30)] + [(None, shared), (7, shared), (7, shared), (9001, None), (9002, ""), (9003, "!!! ..."), (9004, "É é naïve 中文 c1"), (9005, "c1 " * 5000), (9006, "z" * 70_000 + " c1")]
    items = [(i, " ".join(r.choice(pools[i % 4] + ["c1", "c2", "unknown"]) for _ in range(12))) for i in range(12)]
    items += [(50, shared.upper()), (51, None), (52, ""), (53, "unknown only"), (54, "c1 c1 C1"), (55, "é 中文"), (55, "c2"), (0, items[0][1]), (None, "p1w1 p1w2")]
    return rows, items


def plain(found):
    return sorted(str((x.item_id, x.rank, x.doc_id, x.score)) for x in found.collect())


@pytest.mark.parametrize(("shard", "part", "first", "queries", "entries"), [(256, 4096, 8, 512, common.BROADCAST_ENTRIES), (8, 40, 1, 2, common.BROADCAST_ENTRIES), (16, 64, 2, 5, 0)])
def test_ranks(spark, monkeypatch, shard, part, first, queries, entries):
    for name, value in (("SHARD", shard), ("PART", part), ("FIRST", first), ("MORE", 2), ("QUERIES", queries)):
        monkeypatch.setattr(lexical_search, name, value)
    monkeypatch.setattr(common, "BROADCAST_ENTRIES", entries)
    rows, items = corpus()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS shard", "2 AS leaf", "'t' AS term", "3 AS score").repartition(5)
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "'q' AS query", "1 AS rank")
    assert plain(search.ranked(docs, asked, 20)) == brute(rows, items, 20)


def test_visits_stop_early_and_results_stay(spark, monkeypatch):
    for name, value in (("SHARD", 8), ("PART", 64), ("FIRST", 2), ("MORE", 2)):
        monkeypatch.setattr(lexical_search, name, value)
    rows, items = corpus(2, 600)
    index = search.built(spark.createDataFrame(rows, DOCS))
    wanted = search.query_terms(spark.createDataFrame(items, ITEMS))
    found, visits = search.searched(index, wanted.select("query", "term", "times"), 3)
    shards = index.members.count()
    per_query = visits.groupBy("query").count().collect()
    assert shards >= 75 and visits.distinct().count() == visits.count()
    assert sum(x["count"] for x in per_query) < 0.6 * shards * len(per_query)
    names = wanted.select("query", "item_id").distinct()
    assert plain(found.join(names, "query")) == brute(rows, items, 3)


def test_every_document_is_indexed_whole(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SAMPLE", 50)
    rows, _ = corpus(3)
    index = search.built(spark.createDataFrame(rows, DOCS))
    ids = [i for x in index.members.collect() for i in x.ids]
    assert sorted(map(str, ids)) == sorted(str(d) for d, t in rows if terms(t))
    postings = index.entries.selectExpr("sum(df) AS n", "sum(length(places) div 2) AS p").first()
    assert postings.n == postings.p == sum(len(set(terms(t))) for _, t in rows)


def test_bisection_puts_like_documents_together():
    r = np.random.default_rng(5)
    group = r.integers(0, 4, 512)
    doc = np.repeat(np.arange(512), 12)
    term = group[doc] * 50 + r.integers(0, 50, len(doc))
    pairs = np.unique(doc * 1000 + term)
    order, shard = search.bisected(pairs // 1000, pairs % 1000, 512, 32)
    assert sorted(order) == list(range(512)) and np.bincount(shard).max() <= 32
    pure = np.mean([np.bincount(group[order[shard == s]]).max() / (shard == s).sum() for s in range(shard[-1] + 1)])
    assert pure > 0.8


def test_tree_deals_by_terms():
    r = random.Random(6)
    texts = [" ".join(f"g{i % 8}t{r.randrange(40)}" for _ in range(30)) for i in range(800)]
    tree = search.Tree.loaded(search._fitted(pa.array(texts, pa.string())).dumped())
    leaves = np.concatenate([tree.leaves(p) for p in search.tokenised(pa.array(texts, pa.string()))])
    pure = np.mean([np.bincount(np.arange(800)[leaves == v] % 8).max() / (leaves == v).sum() for v in np.unique(leaves)])
    assert len(np.unique(leaves)) >= 8 and pure > 0.6


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert search.ranked(docs, items).collect() == []
    assert search.ranked(docs, spark.createDataFrame([(1, "a")], ITEMS)).collect() == []
    assert search.ranked(spark.createDataFrame([(1, "a b")], DOCS), items).collect() == []


def test_agrees_with_duckdb(spark, sf):
    import duckdb

    from lakewright.llm import queries

    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    result = connection.sql(queries.ORACLE_SQL["op11_lexical_search"])
    names = result.columns
    assert sorted(tuple(x[c] for c in names) for x in queries.op11_lexical_search(spark, sf).collect()) == sorted(result.fetchall())
