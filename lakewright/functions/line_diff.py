"""Line diffs of revisions: a shortest edit script in linear space, its hunks, and how to apply it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.plans.registry import query

def _middle(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """The start and end of a run of equal lines in the middle of a shortest script of a[a0:a1] and b[b0:b1], found from both ends at once."""
    n, m = a1 - a0, b1 - b0
    half, odd, delta = (n + m + 1) // 2, (n - m) % 2, n - m
    size = 2 * half + 2
    front, back = [0] * size, [0] * size
    for d in range(half + 1):
        for forward in (True, False):
            own, other = (front, back) if forward else (back, front)
            for k in range(-d, d + 1, 2):
                x = own[(k + 1) % size] if k == -d or (k != d and own[(k - 1) % size] < own[(k + 1) % size]) else own[(k - 1) % size] + 1
                y, x0 = x - k, x
                if forward:
                    while x < n and y < m and a[a0 + x] == b[b0 + y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[a1 - 1 - x] == b[b1 - 1 - y]:
                        x, y = x + 1, y + 1
                own[k % size] = x
                z = delta - k
                met = abs(z) <= (d - 1 if forward else d) and x + other[z % size] >= n
                if met and odd == forward:
                    return (a0 + x0, b0 + x0 - k, a0 + x, b0 + y) if forward else (a1 - x, b1 - y, a1 - x0, b1 - (x0 - k))
    raise AssertionError("the two ends must meet")


def _kept(a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
    """(place in a, place in b) of the lines that a shortest script keeps, in order."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            yield a0, b0
            a0, b0 = a0 + 1, b0 + 1
        tail = 0
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1, tail = a1 - 1, b1 - 1, tail + 1
        if tail:
            todo.append((a1, a1 + tail, b1, b1 + tail))
        if a0 < a1 and b0 < b1:
            x0, y0, x1, y1 = _middle(a, b, a0, a1, b0, b1)
            todo += [(x1, a1, y1, b1), (x0, x1, y0, y1), (a0, x0, b0, y0)]


def line_edits(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """(op, line) of a shortest script: keep, del, add; what is deleted comes before what is added in its place.

    Lines that only one side has are not compared.  The time is that of the lines that are left, times those of them that differ.
    """
    number = {line: k for k, line in enumerate(set(old) & set(new))}
    left, right = ([i for i, line in enumerate(lines) if line in number] for lines in (old, new))
    out, i, j = [], 0, 0
    for x, y in _kept([number[old[i]] for i in left], [number[new[j]] for j in right]):
        out += [("del", line) for line in old[i : left[x]]] + [("add", line) for line in new[j : right[y]]] + [("keep", old[left[x]])]
        i, j = left[x] + 1, right[y] + 1
    return out + [("del", line) for line in old[i:]] + [("add", line) for line in new[j:]]


def hunks(edits: list[tuple[str, str]], context: int = 1) -> Iterator[tuple[int, int, int, list[tuple[str, str]]]]:
    """(hunk, first old line, first new line, edits): the changes with so many kept lines around them; lines are numbered from 1."""
    changed = [i for i, (op, _) in enumerate(edits) if op != "keep"]
    spans: list[list[int]] = []
    for i in changed:
        if spans and i - context <= spans[-1][1] + 1:
            spans[-1][1] = i + context
        else:
            spans.append([i - context, i + context])
    old = new = at = 0
    for number, (lo, hi) in enumerate(spans, 1):
        lo = max(lo, 0)
        for op, _ in edits[at:lo]:
            old, new = old + (op != "add"), new + (op != "del")
        part = edits[lo : hi + 1]
        yield number, old + 1, new + 1, part
        for op, _ in part:
            old, new = old + (op != "add"), new + (op != "del")
        at = lo + len(part)


def applied(old: list[str], parts: list[tuple[int, list[tuple[str, str]]]]) -> list[str]:
    """The new lines, from the old ones and (first old line, edits) of the hunks; ValueError if a hunk does not fit."""
    out, at = [], 0
    for first, edits in parts:
        out += old[at : first - 1]
        at = first - 1
        for op, line in edits:
            if op != "add":
                if at >= len(old) or old[at] != line:
                    raise ValueError(f"line {at + 1} is not {line!r}")
                at += 1
            if op != "del":
                out.append(line)
    return out + old[at:]


def lines_of(text: str | None) -> list[str]:
    """A text's lines; what ends a line belongs to none, and an empty text has none."""
    return text.split("\n") if text else []


DIFF = "hunk int, old_line int, new_line int, place int, op string, line string"


def diffs(pairs: DataFrame, key: str, context: int = 1) -> DataFrame:
    """(key, hunk, old_line, new_line, place, op, line) of pairs(key, old, new): the lines of the hunks that lead from one text to the other.

    A null is an empty text; equal texts have no hunk.  A pair is one row and is compared in one task, in memory of the size of its texts.
    """
    kind = pairs.schema[key].dataType.simpleString()
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            owners, rows = [], []
            for i, (old, new) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for number, first, second, part in hunks(line_edits(lines_of(old), lines_of(new)), context):
                    owners += [i] * len(part)
                    rows += [(number, first, second, place, op, line) for place, (op, line) in enumerate(part)]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [key, "hunk", "old_line", "new_line", "place", "op", "line"])

    return pairs.select(key, "old", "new").mapInArrow(run, f"{key} {kind}, {DIFF}")


def patched(olds: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(key, new): olds(key, old) with the hunks of changes applied; a text without hunks stays."""
    kind = olds.schema[key].dataType.simpleString()
    part = F.struct("hunk", "place", "old_line", "op", "line")
    held = olds.select(key, "old").join(changes.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("parts")), key, "left")

    def run(batches):
        for batch in batches:
            out = []
            for old, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by_hunk: dict[int, tuple[int, list]] = {}
                for p in parts or ():
                    by_hunk.setdefault(p["hunk"], (p["old_line"], []))[1].append((p["op"], p["line"]))
                out.append("\n".join(applied(lines_of(old), list(by_hunk.values()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "new"])

    return held.mapInArrow(run, f"{key} {kind}, new string")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, old, new): every document's lines, and the same with each seventh left out, each fifth changed, the first three moved to the end and a line repeated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = F.split(F.coalesce("text", F.lit("")), r"\n|(?<=[.!?]) ", -1)
    kept = F.filter("l", lambda x, i: i % 7 != 6)
    changed = F.transform(kept, lambda x, i: F.when(i % 5 == 4, F.concat(x, F.lit(" (changed)"))).otherwise(x))
    moved = F.concat(F.slice(changed, 4, 1 << 30), F.slice(changed, 1, 3), F.slice(changed, 1, 1))
    return docs.select("doc_id", lines.alias("l")).select("doc_id", F.array_join("l", "\n").alias("old"), F.array_join(moved, "\n").alias("new"))


@query(
    "revision_diffs",
    r"""WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?]) ', '\1' || chr(10), 'g'), '\n') AS l FROM documents),
  k AS (SELECT doc_id, l, list_filter(l, lambda x, i: i % 7 <> 0) AS s FROM d), c AS (SELECT doc_id, l, list_transform(s, lambda x, i: CASE WHEN i % 5 = 0 THEN x || ' (changed)' ELSE x END) AS s FROM k),
  n AS (SELECT doc_id, l, s[4:] || s[1:3] || s[1:1] AS s FROM c)
  SELECT doc_id, sha256(array_to_string(s, chr(10))) AS new_sha256, CAST(CASE WHEN array_to_string(s, chr(10)) = '' THEN 0 ELSE len(s) END - CASE WHEN array_to_string(l, chr(10)) = '' THEN 0 ELSE len(l) END AS BIGINT) AS grown FROM n""",
)
def revision_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document patched by the diff of its revision, and by how many lines the diff makes it grow."""
    pairs = revisions(spark, sf_dir)
    changes = diffs(pairs, "doc_id")
    grown = changes.groupBy("doc_id").agg(F.sum(F.when(F.col("op") == "add", 1).when(F.col("op") == "del", -1).otherwise(0)).alias("grown"))
    new = patched(pairs, changes, "doc_id").select("doc_id", F.sha2("new", 256).alias("new_sha256"))
    return new.join(grown, "doc_id", "left").select("doc_id", "new_sha256", F.coalesce("grown", F.lit(0)).cast("long").alias("grown"))
