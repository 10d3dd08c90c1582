"""Fingerprints of any text, the true likeness, and neighbours for ids anywhere in the range."""

import random

import brute
import pytest

from lakewright.llm import spot_signatures as sp

DOCS = "doc_id long, text string"


def words(n, seed, stock=3000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(stock)}" for _ in range(n))


def sets(text):
    return {text[i : i + 8] for i in range(0, len(text), 8)}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_texts_without_common_words(spark):
    a, b = words(1000, 1), words(1000, 2)
    opening = "alpha beta gamma delta"
    han = "".join(chr(0x4E00 + (i * 7919) % 9000) for i in range(400))
    rows = [(1, f"{opening} {a}"), (2, f"{opening} {b}"), (3, a), (4, a + " " + words(30, 3)), (5, han), (6, han[:390])]
    got = {x.doc_id: x for x in sp.edited_fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].near_next < 0.1 and got[1].near_edited < 0.7
    assert got[3].near_next > 0.9
    assert got[5].near_next > 0.9 and len(sets(got[5].fingerprint)) > 20


def test_likeness_is_the_jaccard_of_the_fingerprints(spark):
    prose = "the cat sat on the mat and the dog ate of the bone in a house by the sea with an old man who was not at home "
    rows = [(i, prose * (i % 3) + words(i * 40, i)) for i in range(12)] + [(20, ""), (21, None), (22, "one"), (23, words(3000, 9) + " one")]
    got = sorted(sp.edited_fingerprints(spark.createDataFrame(rows, DOCS)).collect(), key=lambda x: x.doc_id)
    for x, after in zip(got, got[1:] + got[:1]):
        assert x.near_next == pytest.approx(jaccard(sets(x.fingerprint), sets(after.fingerprint)))
        assert x.near_edited == pytest.approx(jaccard(sets(x.fingerprint), sets(x.edited_fingerprint)))


@pytest.mark.parametrize("far", [[], [-(2**63), 2**63 - 1], [10**15]])
def test_neighbours_for_ids_anywhere(spark, far, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 7)
    rows = [(i * 3, words(i % 9, i)) for i in range(300)] + [(i, words(5, i)) for i in far] + [(6, "again"), (6, "again")]
    want = sorted(rows, key=lambda r: r)
    got = sorted(sp.edited_fingerprints(spark.createDataFrame(rows, DOCS)).collect(), key=lambda x: x.doc_id)
    assert len(got) == len(rows)
    expected = {i: v for i, v in brute.edited(want).items() if i != 6}
    assert {x.doc_id: (x.n_chars, x.edited_sha256) for x in got if x.doc_id != 6} == expected


def test_blocks_hold_few_rows(spark):
    from pyspark.sql import functions as F

    ids = list(range(0, 40000, 2)) + [10**18]
    cuts = sorted(range(100, 40000, 100))
    counts = spark.createDataFrame([(i,) for i in ids], "doc_id long").groupBy(sp._block(cuts).alias("b")).agg(F.count("*").alias("n")).collect()
    assert max(x.n for x in counts) <= 51 and len(counts) == len(cuts) + 1


def test_similar_pairs_against_brute_force(spark):
    r, rows = random.Random(4), []
    for family in range(12):
        base = words(200, 100 + family).split() + "the of and in to".split() * 8
        r.shuffle(base)
        for _ in range(4):
            own = list(base)
            for _ in range(r.randrange(0, 16)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, DOCS)
    prints = {x.doc_id: frozenset(x.signatures) for x in sp.fingerprints(docs).collect()}
    first = {}
    for i in sorted(prints):
        first.setdefault(prints[i], i)
    own = sorted(first.items(), key=lambda x: x[1])
    want = {(i, j) for k, (a, i) in enumerate(own) for b, j in own[k + 1 :] if jaccard(a, b) >= 0.8}
    assert {(x.a, x.b) for x in sp.similar_pairs(docs).collect()} == want and want
