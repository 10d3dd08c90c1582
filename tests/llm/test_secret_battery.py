"""The randomness battery: a plain Python version of its tests, planted keys among prose, and ordinary long tokens."""

import collections
import math
import random
import re

import pytest

from lakewright.llm import secret_scan as ss

BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
DOCS = "doc_id long, text string"


def statistics(t):
    """Equal pairs, changes of kind and of vowels, standardised; written from the module's docstring."""
    n = len(t)
    k = 10 if t.isdigit() else 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", t) else 32 if re.fullmatch("[A-Z2-7]+=*", t) and re.search("[2-7]", t) else 26 if re.fullmatch("[a-z]+|[A-Z]+", t) else 67
    equal = sum(c * (c - 1) / 2 for c in collections.Counter(t).values())
    expected = n * (n - 1) / 2 * (ss.REPEAT_MIXED if k > 32 else ss.REPEAT / k)
    shape = 1 / (1 / expected + ss.EXTRA / n)
    out = [(1 - 1 / (9 * shape) - (equal / expected) ** (1 / 3)) * 3 * math.sqrt(shape)]
    bare = re.sub("[+/_=-]", "", t)
    kind = lambda c: "digit" if c.isdigit() else "upper" if c.isupper() else "lower"
    pairs = max(1, len(bare) - 1)
    if k > 32 or (re.search("[0-9]", bare) and re.search("[A-Za-z]", bare)):
        rate = sum(kind(a) != kind(b) for a, b in zip(bare, bare[1:])) / pairs
        out.append((rate - ss.KINDS_RATE) / math.sqrt(ss.KINDS_RATE * (1 - ss.KINDS_RATE) / pairs + ss.KINDS_SPREAD))
    if k not in (10, 16):
        both = [(a.lower() in "aeiouy", b.lower() in "aeiouy") for a, b in zip(t, t[1:]) if a.isalpha() and b.isalpha()]
        m = max(1, len(both))
        out.append(0.0 if len(both) < ss.LETTERS else (ss.VOWELS_RATE - sum(a != b for a, b in both) / m) / math.sqrt(ss.VOWELS_RATE * (1 - ss.VOWELS_RATE) / m + ss.VOWELS_SPREAD))
    return sum(max(-ss.CLIP_Z, min(ss.CLIP_Z, x)) for x in out) / math.sqrt(len(out)) / ss.WIDEN


def test_battery_against_plain_python(spark):
    r = random.Random(1)
    tokens = ["".join(r.choice(a) for _ in range(r.randrange(20, 70))) for a in (BASE62, "0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz", BASE62 + "+/") for _ in range(10)]
    tokens += ["a" * 30, "=" * 25, "docs/getting-started/installation", "abcdefghijklmnopqrstuvwxyz", "0" * 20, "-_" * 15, "ABABABABABABABABABABA2"]
    frame = spark.createDataFrame([(t,) for t in tokens], "token string")
    for name, sql in ss._battery("token").items():
        frame = frame.selectExpr("*", f"{sql} AS {name}")
    for x in frame.select("token", "z").collect():
        assert x.z == pytest.approx(statistics(x.token), abs=1e-9), x.token


def test_planted_keys_are_found_in_documents(spark):
    r = random.Random(2)
    docs = [(x.doc_id, x.text or "") for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    planted = {}
    for n in (24, 28, 32, 40, 48, 64):
        for _ in range(10):
            key = "".join(r.choice(BASE62) for _ in range(n))
            place = r.randrange(len(docs))
            docs[place] = (docs[place][0], docs[place][1] + f" {key} ")
            planted[key] = docs[place][0]
    text = dict(docs)
    spans = {}
    for x in ss.secrets(spark.createDataFrame(docs, DOCS)).collect():
        spans[x.doc_id] = {text[x.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])] for s in filter(None, x.spans.split(",")) if s.startswith("random")}
    assert sum(k in spans[i] for k, i in planted.items()) >= 0.9 * len(planted)
    false = [t for own in spans.values() for t in own if t not in planted and not re.fullmatch("[0-9a-fA-F]{24,}|AKIA[A-Z0-9]+", t)]
    assert len(false) <= 0.05 * len(planted), false


@pytest.mark.parametrize("n", [24, 32, 40, 64])
def test_a_lone_key_of_any_length(spark, n):
    r = random.Random(n)
    found = 0
    for _ in range(5):
        key = "".join(r.choice(BASE62) for _ in range(n))
        found += ss.secrets(spark.createDataFrame([(1, f"some words {key} about /usr/share/documentation/index and state-of-the-art-systems")], DOCS)).first().spans == f"random:11:{11 + n}"
    assert found >= 4


def test_sequences_and_rules_are_not_random(spark):
    odd = ["abcdefghijklmnopqrstuvwxyz0123456789", "=" * 80, "0123456789abcdef" * 3, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "aaaaaaaaaabbbbbbbbbbcccccccccc", "/".join("abcdefghijklmno"), "the-quick-brown-fox-jumps-over-the-lazy-dog"]
    assert not any("random" in x.spans for x in ss.secrets(spark.createDataFrame(list(enumerate(odd)), DOCS)).collect())
