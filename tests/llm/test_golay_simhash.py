"""Golay keys against all words of small distance, fingerprints and components against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lakewright.llm import common, golay_simhash
from lakewright.llm import golay_simhash as golay

DOCS = "doc_id long, text string"


def shingles(text):
    parts, space = [], " \t\n\x0b\x0c\r"
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""):
        if c in space:
            parts.append("")
        elif parts:
            parts[-1] += c
        else:
            parts.append(c)
    words = [p for p in parts if p]
    return [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []


def fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    """doc_id -> smallest doc_id, by all pairs of rows and rows of one doc_id."""
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return sorted((str(d), f"{prints[i]:016x}", str(low.get(root(i)))) for i, (d, _) in enumerate(rows))


def test_the_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)[::97]
    index = golay.decoded(words)
    codeword = (index << np.uint32(11)) | golay._REST[index]
    assert np.bitwise_count(words ^ codeword).max() == 3
    assert np.array_equal(golay.decoded(codeword), index)


@pytest.mark.parametrize("errors", [1, 2])
def test_near_words_share_a_codeword(errors):
    r = np.random.default_rng(errors)
    words = r.integers(0, 1 << 23, 20_000).astype(np.uint32)
    other = words.copy()
    for _ in range(errors):
        other ^= np.uint32(1) << r.integers(0, 23, len(words)).astype(np.uint32)
    a, b = golay.near_codes(words, errors), golay.near_codes(other, errors)
    assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_every_link_has_a_key():
    r = np.random.default_rng(4)
    prints = r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    other = prints.copy()
    for _ in range(3):
        other ^= np.where(r.random(len(prints)) < 0.8, np.uint64(1) << r.integers(0, 64, len(prints)).astype(np.uint64), np.uint64(0))
    keys = []
    for values in (prints, other):
        own = [set() for _ in values]
        for row, key in zip(*golay.fuzzy_keys(values), strict=True):
            own[row].add(int(key))
        keys.append(own)
    assert all(x & y for x, y in zip(*keys, strict=True))
    # any three errors in one segment, two and one, and one in each
    for a in range(64):
        pair = np.array([7, 7 ^ (1 << a) ^ (1 << (a * 7 + 3) % 64) ^ (1 << (a * 5 + 11) % 64)], np.uint64)
        row, key = golay.fuzzy_keys(pair)
        assert set(key[row == 0]) & set(key[row == 1])


TEXTS = ["", None, " \t\n", "one", "One", "two words", "a b c", "A b\tc\n", "é ü 中文 слово", "a b c d e f g", "x " * 3000, "word " + "y" * 90_000, "a\x00b\x01c d e", "a b c d"]


def test_fingerprints(spark):
    texts = TEXTS + ["Mixed CASE text with   many spaces \n and lines"]
    got = golay.simhashes(pa.array(texts, pa.string()))
    assert [int(x) for x in got] == [fingerprint(t) for t in texts]
    # the engine's own hash of a string is the same one
    joined = spark.createDataFrame([(s,) for t in texts[:9] for s in shingles(t)], "s string").select("s", F.xxhash64("s")).collect()
    assert all(h & (2**64 - 1) == xxhash.xxh64_intdigest(s.encode(), 42) for s, h in joined)


def corpus():
    r = random.Random(8)
    base = [f"w{r.randrange(3000)}" for _ in range(400)]
    rows = [(i * 2, t) for i, t in enumerate(TEXTS)]
    for k in range(60):  # a large group of near copies around one text
        own = list(base)
        for _ in range(r.randrange(6)):
            own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        rows.append((100 + k, " ".join(own)))
    rows += [(200 + k, " ".join(f"v{r.randrange(500)}" for _ in range(r.randrange(1, 30)))) for k in range(80)]
    rows += [(7, " ".join(base)), (7, "unlike text of its own here"), (900, "unlike text of its own here"), (None, " ".join(base)), (None, "alone without an id at all"), (5, TEXTS[8]), (5, TEXTS[8])]
    return rows


@pytest.mark.parametrize(("entries", "block"), [(common.BROADCAST_ENTRIES, golay_simhash.BLOCK), (0, 3)])
def test_components(spark, monkeypatch, entries, block):
    monkeypatch.setattr(common, "BROADCAST_ENTRIES", entries)
    monkeypatch.setattr(golay_simhash, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS print", "2 AS key", "'c' AS component_id", "0 AS part").repartition(5)
    found = golay.simhash_components(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in found.collect()) == components(rows)


def test_chains_beyond_the_star(spark, monkeypatch):
    """Fingerprints in a chain of three bits a step are one component, though most are far from the smallest of their keys."""
    monkeypatch.setattr(golay_simhash, "BLOCK", 2)
    r, chain = random.Random(3), [r0 := 0x5A5A_1234_9876_0F0F]
    for _ in range(30):
        for b in r.sample(range(63), 3):
            r0 ^= 1 << b
        chain.append(r0)
    nodes = spark.createDataFrame([(x,) for x in set(chain)], "print long")
    monkeypatch.setattr(golay_simhash, "fingerprints", lambda docs: docs)
    got = golay.simhash_components(nodes.selectExpr("monotonically_increasing_id() AS doc_id", "print"))
    assert len({x.component_id for x in got.collect()}) == 1


def test_empty_table(spark):
    assert golay.simhash_components(spark.createDataFrame([], DOCS)).collect() == []
