"""Fuzzy matches against all pairs; line diffs against the longest common subsequence."""

import random
from difflib import SequenceMatcher

import pytest

from lakewright.functions import line_diff
from lakewright.operators import fuzzy

NAME = "name string"


def names(seed, count, stems=30):
    r = random.Random(seed)
    made = []
    for _ in range(count):
        word = list("".join(random.Random(r.randrange(stems)).choice("abcdefgéü") for _ in range(r.randrange(1, 14))))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(word) + 1)
            if r.random() < 0.5:
                word.insert(at, r.choice("abcxyz"))
            elif word:
                word.pop(min(at, len(word) - 1))
        made.append("".join(word))
    return made


@pytest.mark.parametrize("ratio", [0.84, 0.7, 0.95])
def test_fuzzy_pairs(spark, ratio):
    left, right = names(1, 250), names(2, 250)
    left += ["abcd", "aabb", "a" * 60, "", "straße"]
    right += ["abcd", "bbaa", "a" * 55, "", "strasse"]
    frames = [spark.createDataFrame([(x,) for x in [*side, None]], NAME) for side in (left, right)]
    got = {(x.a, x.b): x.ratio for x in fuzzy.fuzzy_pairs(*frames, ratio, 1).collect()}
    want = {(a, b): SequenceMatcher(None, a, b).ratio() for a in set(left) for b in set(right) if a and b}
    assert got == {k: v for k, v in want.items() if v >= ratio}


def test_keys_lose_no_pair():
    r = random.Random(5)
    for _ in range(3000):
        a = "".join(r.choice("abcde") for _ in range(r.randrange(1, 12)))
        b = "".join(r.choice("abcde") for _ in range(r.randrange(1, 12))) if r.random() < 0.3 else "".join(c for c in a if r.random() < 0.9) + r.choice(["", "x"])
        if b and SequenceMatcher(None, a, b).ratio() >= 0.84:
            rank = {c: i for i, c in enumerate("edcbax")}
            assert fuzzy.keys(a, rank, 0.84, True) & fuzzy.keys(b, rank, 0.84, False), (a, b)


def test_word_matches(spark):
    left = ["registr", "ministry", "abc", "office", "kommission", "registers", ""]
    right = ["registro", "ministerio", "abc", "officer", "comision", "regis", "official"]
    got = {(x.a, x.b) for x in fuzzy.word_matches(*(spark.createDataFrame([(x,) for x in side], NAME) for side in (left, right))).collect()}

    def match(a, b):
        short = min(len(a), len(b))
        return a == b or (short >= 4 and SequenceMatcher(None, a, b).ratio() >= 0.84) or (short >= 5 and abs(len(a) - len(b)) <= 2 and a[:5] == b[:5])

    assert got == {(a, b) for a in left for b in right if a and match(a, b)}


def test_registered_query(spark, sf):
    import __spark_entry__

    rows = __spark_entry__.queries()["fuzzy_matches"](spark, sf).collect()
    assert rows and len(set(map(tuple, rows))) == len(rows)


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_scripts_are_shortest():
    r = random.Random(1)
    for _ in range(3000):
        letters = "abcde"[: r.randrange(1, 6)]
        a, b = ([r.choice(letters) for _ in range(r.randrange(14))] for _ in range(2))
        edits = line_diff.line_edits(a, b)
        assert [line for op, line in edits if op != "add"] == a and [line for op, line in edits if op != "del"] == b
        assert sum(op == "keep" for op, _ in edits) == lcs(a, b)
        for context in (0, 1, 3):
            assert line_diff.applied(a, [(first, part) for _, first, _, part in line_diff.hunks(edits, context)]) == b


def test_hunks_of_texts(spark):
    old, new = "a\nb\nc\nd\ne\nf\ng", "a\nB\nc\nd\ne\ng\nh"
    pairs = [(1, old, new), (2, old, old), (3, None, "x\ny"), (4, "x\n", None), (5, "", ""), (6, "é\r\n", "é\n"), (7, "\n", "")]
    table = spark.createDataFrame(pairs, "k long, old string, new string")
    changes = line_diff.diffs(table, "k").collect()
    assert [(x.hunk, x.old_line, x.new_line, x.op, x.line) for x in sorted(changes, key=lambda x: (x.k, x.hunk, x.place)) if x.k == 1] == [
        (1, 1, 1, "keep", "a"), (1, 1, 1, "del", "b"), (1, 1, 1, "add", "B"), (1, 1, 1, "keep", "c"), (2, 5, 5, "keep", "e"), (2, 5, 5, "del", "f"), (2, 5, 5, "keep", "g"), (2, 5, 5, "add", "h"),
    ]
    assert {x.k for x in changes} == {1, 3, 4, 6, 7}
    got = {x.k: x.new for x in line_diff.patched(table, line_diff.diffs(table, "k", 0), "k").collect()}
    assert got == {k: b or "" for k, _, b in pairs}


def test_a_hunk_that_does_not_fit():
    with pytest.raises(ValueError, match="line 1"):
        line_diff.applied(["x"], [(1, [("del", "y")])])
