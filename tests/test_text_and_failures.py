"""Failure classes and text rules on hand-written rows, nulls, and against plain Python."""

import random
import re
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from lakewright.functions import failure_kinds as fk
from lakewright.functions import text_rules as tr

STEP = ", ".join(["i int", *(f"{c} string" for c in fk.FIELDS), "source_id string"])


def test_every_failure_rule(spark):
    steps = spark.createDataFrame([(i, *given, "s") for i, (given, _) in enumerate(fk.STEPS)], STEP)
    got = {r.i: (r.kind, r.failure, r.reason) for r in fk.classify(steps).collect()}
    assert got == {i: want for i, (_, want) in enumerate(fk.STEPS)}


def test_failures_of_empty_and_odd_steps(spark):
    blank = (None,) * 6
    rows = [(0, *blank, None), (1, None, None, "dropped", None, None, None, None), (2, "", "", "", "", "", "", ""), (3, None, "{torn", "[", "{", "}", "{", "s"), (4, "failure", None, None, None, None, None, None)]
    got = {r.i: r.failure for r in fk.classify(spark.createDataFrame(rows, STEP)).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: "failure"}
    assert fk.classify(spark.createDataFrame([], STEP)).count() == 0


@pytest.mark.parametrize(("text", "want"), [
    ('{"e":[{"host":"a.invalid"}]}', '{"e":[]}'),
    ('{"e":[{"host":"a.invalid"}, {"host":"b.invalid","d":1},{"host":"c.org"}]}', '{"e":[{"host":"c.org"}]}'),
    ('{"e":[{"host":"c.org"},{"d":1,"host":"a.invalid"}]}', '{"e":[{"host":"c.org"}]}'),
    ('{"e":{"host":"a.invalid"}}', '{"e":{"host":"a.invalid"}}'),
    ("plain .invalid text", "plain .invalid text"),
])
def test_probes_leave(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(fk.without_probes(F.col("t")).alias("t")).first().t == want


def test_every_text_rule(spark):
    rows = spark.createDataFrame([(i, rule, text) for i, (rule, text, _) in enumerate(tr.CASES)], "i int, rule string, text string")
    got = {r.i: r.g for r in rows.select("i", F.when(F.col("rule") == "ascii", tr.ascii_key("text")).otherwise(tr.by_rule(F.col("rule"), F.col("text"))).alias("g")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(tr.CASES)}


def test_nulls_of_text_rules(spark):
    t = F.col("t")
    row = spark.createDataFrame([(None,)], "t string").select(
        tr.unrepeated(t).alias("a"), tr.link_identity(t).alias("b"), tr.dataset_suffix(t).alias("c"), tr.ascii_key("t").alias("d"), tr.safety_verdict(t).alias("e"), tr.typed_cell(t, F.lit("integer")).alias("f")
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, tuple(row.f)) == ("", None, None, None, "unknown", (None, None))


def identity(url):
    """The rule over Python's own splitting of links."""
    parts = urlsplit(url)
    host = (parts.hostname or "").lower().rstrip(".")
    names = [p.split("=")[0] for p in parts.query.split("&")]
    if not host or parts.scheme not in ("http", "https") or any(re.search(tr.AUTH_NAMES, n) for n in names):
        return None
    try:
        port = parts.port
    except ValueError:
        return None
    netloc = f"[{host}]" if ":" in host else host
    if port is not None and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        netloc += f":{port}"
    return parts._replace(netloc=netloc).geturl()


def test_links_against_python(spark):
    r = random.Random(3)
    pick = lambda *x: r.choice(x)
    urls = [
        pick("http", "HTTPS", "ftp") + "://" + pick("", "u@", "u:p@") + pick("A.org", "b.example.COM.", "[::1]", "") + pick("", ":", ":80", ":443", ":8080", ":99999", ":ab") + pick("", "/", "/x/Y", "/a:b@c")
        + pick("", "?", "?q=1&b", "?Token=2", "?x=token") + pick("", "#", "#f?g")
        for _ in range(400)
    ]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", tr.link_identity(F.col("u")).alias("i")).collect()
    assert [(x.u, x.i) for x in got] == [(u, identity(u)) for u in urls]


def test_repeated_labels_against_python(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["ab", "c"]) for _ in range(r.randrange(9))) for _ in range(200)]

    def once(text):
        words = text.split()
        for n in (4, 3, 2):
            if words and len(words) % n == 0 and words == words[: len(words) // n] * n:
                return " ".join(words[: len(words) // n])
        return " ".join(words)

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tr.unrepeated(F.col("t")).alias("u")).collect()
    assert [(x.t, x.u) for x in got] == [(t, once(t)) for t in texts]


@pytest.mark.parametrize("ranges", [1, 7])
def test_positions_over_ranges(spark, ranges):
    from lakewright.operators.ranking import positions

    r = random.Random(5)
    rows = [(i, r.choice([None, 1, 1, 1, 2, 9])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int")
    got = {x.id: x.place for x in positions(df, [F.col("v").desc_nulls_first(), F.col("id").asc()], ranges=ranges).collect()}
    order = sorted(rows, key=lambda x: (x[1] is not None, -(x[1] or 0), x[0]))
    assert got == {i: n for n, (i, _) in enumerate(order, 1)}
    assert positions(df.where("id < 0"), [F.col("id").asc()]).count() == 0


def test_puts_are_idempotent(spark, tmp_path):
    from lakewright.sources.lake import put_bronze, scan_bronze

    payloads = spark.createDataFrame([(b"a",), (b"a",), (b"",), (None,), (bytes(range(256)) * 5000,)], "content binary")
    first = put_bronze(payloads, f"file://{tmp_path}")
    assert sorted((r.length, r.put) for r in first.collect()) == [(0, True), (1, True), (1280000, True)]
    more = put_bronze(payloads.union(spark.createDataFrame([(b"b",)], "content binary")), f"file://{tmp_path}")
    assert sorted((r.length, r.put) for r in more.collect()) == [(0, False), (1, False), (1, True), (1280000, False)]
    stored = scan_bronze(spark, f"file://{tmp_path}").collect()
    assert {r.bronze_key for r in stored} == {r.bronze_key for r in more.collect() if r.length} and all(r.intact for r in stored)
    assert sorted(p.name[:5] for p in tmp_path.iterdir()) == ["bronze"[:5]]
