"""What the bisection of a part holds by posting, and how large the batches of texts are that reach the workers of the index."""

import tracemalloc
import uuid

import numpy as np
from pyspark import cloudpickle

from lakewright.llm import lexical_search as search


def test_bisection_holds_few_bytes_a_posting():
    doc, term = np.divmod(np.flatnonzero(np.random.default_rng(1).random(1024 * 2000) < 0.5), 2000)
    tracemalloc.start()
    try:
        order, shard = search.bisected(doc, term, 1024, 256)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(order) == list(range(1024)) and np.bincount(shard).max() <= 256
    assert peak < 45 * len(doc)


def test_nodes_are_halved_each_for_itself(monkeypatch):
    r = np.random.default_rng(2)
    doc, term = np.divmod(np.flatnonzero(r.random(300 * 50) < 0.3), 50)
    node, side = r.integers(0, 3, 300), r.random(300) < 0.5
    whole = search.halved(doc, term, node, side)
    monkeypatch.setattr(search, "STRIDE", 97)
    assert (search.halved(doc, term, node, side) == whole).all()
    for v in range(3):
        mine, held = np.flatnonzero(node == v), node[doc] == v
        assert (search.halved(np.searchsorted(mine, doc[held]), term[held], np.zeros(len(mine), int), side[mine]) == whole[mine]).all()
        assert whole[mine].sum() == side[mine].sum()


def test_the_index_is_made_from_small_batches(spark, tmp_path, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, folder = spark.conf.get(name), str(tmp_path)
    real = search.tokenised

    def noting(column):  # reaches the workers with the functions of the tasks
        with open(f"{folder}/{uuid.uuid4()}", "w") as out:
            out.write(str(column.nbytes))
        return real(column)

    monkeypatch.setattr(search, "tokenised", noting)
    cloudpickle.register_pickle_by_value(search)
    try:
        index = search.built(spark.range(0, 20_000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 400) AS text"))
    finally:
        cloudpickle.unregister_pickle_by_value(search)
    sizes = [int(p.read_text()) for p in tmp_path.iterdir() if p.is_file()]
    largest = sorted(sizes, reverse=True)
    assert sum(sizes) > 76 << 20 and largest[1] < 6 << 20  # the sample is one column in one task
    assert index.documents == 20_000 and spark.conf.get(name) == before
