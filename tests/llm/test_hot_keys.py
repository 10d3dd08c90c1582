"""Joins against hot keys, repeated ids with different texts, very long phrases lists, and one offset per source."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from lakewright.llm import common, decontamination, mixing, ngram_jaccard, substring_dedup

DOCS = "doc_id long, text string"


def words(n, seed, stock=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(stock)}" for _ in range(n))


def test_join_hot(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id")
    table = common.materialise(spark.createDataFrame([(0, "a"), (2500, "b"), (9999, "c")], "k long, v string"))
    want = sorted(map(tuple, common.join_hot(rows, table, "k", "id").collect()))
    monkeypatch.setattr(common, "BROADCAST_ENTRIES", 0)
    salted = common.join_hot(rows, table, "k", "id")
    assert sorted(map(tuple, salted.collect())) == want and len(want) == 2001 and salted.columns == ["k", "id", "v"]


def test_texts_of_one_id_keep_their_links(spark):
    a, b, c = words(100, 1), words(100, 2), words(100, 3)
    near = lambda t, k: " ".join(w if i % 50 != 49 else f"x{k}" for i, w in enumerate(t.split()))
    rows = [(5, a), (5, b), (7, near(a, 1)), (8, near(b, 2)), (9, c), (9, c), (3, near(c, 3)), (None, a), (11, None), (11, "")]
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_jaccard.link_components(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == [(-1, 96, -1), (3, 96, 3), (5, 96, 5), (5, 96, 5), (7, 96, 5), (8, 96, 5), (9, 96, 3), (9, 96, 3), (11, 0, 11), (11, 0, 11)]


def test_sets_go_in_batches_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BATCH_BYTES", 1000)
    base = words(200, 7).split()
    texts = [" ".join(w if i != k else f"y{k}" for i, w in enumerate(base)) for k in range(30)]
    got = {r.doc_id: r.component_id for r in ngram_jaccard.link_components(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert set(got.values()) == {0}


def test_one_sentence_in_many_items(spark):
    shared = words(12, 8)
    items = [(i, f"{words(15, 100 + i)} {shared}") for i in range(300)]
    docs = [(1, f"{words(40, 9)} {shared} " * 200), (2, words(50, 10)), (3, None)]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute.contamination(docs, items)
    assert got == {i: w[:3] for i, w in want.items()} and got[1][2] == 300


def test_large_sources_use_their_first_offset(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(1, 60), f"s{i % 2}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized, targets = mixing._plan(docs, mixing.WEIGHTS, 1.0, 0)
    first = F.pmod(F.xxhash64(mixing._name(), F.lit(0), F.lit(0)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    assert all(x.offset == x.first for x in targets.select("offset", first.alias("first")).collect())
    # a plain systematic sampler over the same order takes the same copies
    placed = mixing._placed(sized, targets, 0).withColumn("copies", mixing._copies(F.col("offset"), 3)).collect()
    import math

    for x in placed:
        rate = x.target / x.source_size
        assert x.copies == math.floor(x._last * rate + x.offset) - math.floor((x._last - 1) * rate + x.offset)
    for name in ("s0", "s1"):
        own = sorted(x._last for x in placed if x.source == name)
        assert own == list(range(1, len(own) + 1))


@pytest.mark.parametrize("rows", [1, 5_000])
def test_cells_grow_with_the_table(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "CELL", 100)
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("hot").alias("source"))
    sized, targets = mixing._plan(docs, mixing.WEIGHTS, 1.0, 0)
    out = mixing.with_copies(sized, targets, 0)
    assert out.agg(F.sum("copies")).first()[0] in (rows - 1, rows, rows + 1)


@pytest.mark.parametrize("run", [1, 50, substring_dedup.RUN])
@pytest.mark.parametrize("entries", [0, common.BROADCAST_ENTRIES])
def test_common_passages_are_combined_before_the_shuffle(spark, monkeypatch, run, entries):
    monkeypatch.setattr(substring_dedup, "RUN", run)
    monkeypatch.setattr(common, "BROADCAST_ENTRIES", entries)
    passage, line = words(60, 11), "all work and no play "
    texts = [words(15, 100 + i) + " " + passage + " " + words(i % 7, 200 + i) for i in range(40)] + [line * 30, line * 3, line * 30, "", None, passage, passage, "x " * 19, "x " * 19, "y " * 20, "y " * 20]
    pairs = list(enumerate(texts, -20))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup_digests(spark.createDataFrame(pairs, DOCS)).collect()}
    assert got == brute.kept([(i, t or "") for i, t in pairs])


def test_rows_of_one_hash_are_bounded_by_runs(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RUN", 1 << 12)
    docs = spark.createDataFrame([(i, words(60, 11)) for i in range(500)], DOCS).repartition(4)
    keyed = substring_dedup._keyed(docs)
    entries = substring_dedup._anchors(keyed, ["did"], 20)
    shape = entries.groupBy("h").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    places = entries.agg(F.sum(F.when(F.col("also").isNull(), 1).otherwise(F.size("also")))).first()[0]
    assert shape <= 8 and places == 500 * sum(i % 13 in (0, 1, 3, 9) for i in range(53))
