"""Repairs against exhaustive search, a plain programme over strings, and odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lakewright.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def exhaustive(signature):
    """(cost, audit) over all edits with at most two insertions in a row."""
    best, adds = None, ["", "u", "a", "ua", "au"]
    choices = [[("D", "", 3)] if c == "-" else [("D", "", 3), ("K", c.lower(), c.isupper()), ("R", "u", 2 + c.isupper()), ("R", "a", 2 + c.isupper())] for c in signature]
    for rows in itertools.product(*choices):
        for gaps in itertools.product(adds, repeat=len(signature) + 1):
            roles = gaps[0] + "".join(role + gap for (_, role, _), gap in zip(rows, gaps[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(gaps[0]) + "".join(edit + "I" * len(gap) for (edit, _, _), gap in zip(rows, gaps[1:], strict=True))
                found = (sum(cost for _, _, cost in rows) + 2 * sum(map(len, gaps)), audit)
                best = found if best is None else min(best, found)
    return best


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_cheapest_edits(length):
    signatures = ["".join(c) for c in itertools.product("suaxSUAX-", repeat=length)]
    if length == 3:
        signatures = random.Random(5).sample(signatures, 40)
    for signature, cost, audit in repair.solved(sorted(signatures)):
        assert (cost, audit) == exhaustive(signature), signature


def by_strings(signature):
    """The same programme with whole audits as values."""
    step = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(best):
        for _ in range(3):
            for q, (cost, audit) in list(best.items()):
                to = step[q]
                best[to] = min(best.get(to, (1 << 60, "")), (cost + 2, audit + "I"))
        return best

    best = inserted({0: (0, "")})
    for c in signature:
        after = {}
        for q, (cost, audit) in best.items():
            moves = [(q, 3, "D")]
            if c != "-":
                keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((c.lower(), q))
                moves += ([(keep, int(c.isupper()), "K")] if keep else []) + [(step[q], 2 + c.isupper(), "R")]
            for to, more, edit in moves:
                after[to] = min(after.get(to, (1 << 60, "")), (cost + more, audit + edit))
        best = inserted(after)
    return min(best[q] for q in (0, 3) if q in best)


def test_long_signatures_share_prefixes(monkeypatch):
    r, layers = random.Random(2), []
    stem = "".join(r.choice("uuaaasUA-x") for _ in range(200))
    signatures = sorted({stem[:k] + "".join(r.choice("uaUA-") for _ in range(5)) for k in range(0, 200, 10)} | {stem, "ua" * 150, ""})
    plain = repair.next_layer
    monkeypatch.setattr(repair, "next_layer", lambda *a: layers.append(1) or plain(*a))
    for signature, cost, audit in repair.solved(iter(signatures)):
        assert (cost, audit) == by_strings(signature)
    nodes = {s[:k] for s in signatures for k in range(1, len(s) + 1)}
    assert len(layers) == len(nodes) < sum(map(len, signatures))


def brute(rows):
    """The report of rows (conv_id, turn, role, text)."""
    space, out = " \t\n\x0b\x0c\r", {}
    text_of = lambda x: " " if x is None else x
    for conv_id in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in [r for r in rows if r[0] == conv_id]:
            kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            role, text = text_of(role), text_of(text)
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        counts, seen, signature = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), ""
        for _, role, text in kept:
            bare = text.rstrip(space)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signature += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            if fault:
                counts[fault] += 1
        turns = [t for t, _, _ in kept if t is not None]
        initials = [role[:1] for _, role, _ in kept]
        cost, audit = by_strings(signature)
        body, state, at, step = [], 0, iter(kept), {0: 2, 1: 2, 2: 3, 3: 2}
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(at)
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            elif edit in "IR":
                state = step[state]
                role = "user" if state == 2 else "assistant"
            if edit != "D":
                body.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv_id] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest())
    return out


def test_odd_tables(spark):
    r, rows = random.Random(3), []
    texts = ["Hello there.", "no end", "", None, " \t", "Why?", "ok!  ", "a. ", "x" * 50_000 + ".", "naïve 中文。", "Hello there."]
    for conv in [*range(60), None]:
        for turn in range(r.randrange(1, 9)):
            rows.append((conv, None if r.random() < 0.1 else turn * r.randrange(1, 3), r.choice(["user", "assistant", "system", "tool", None, "", "user"]), r.choice(texts)))
    rows += [(70, 1, "user", "Same."), (70, 1, "user", "Same."), (71, None, "user", "A."), (71, None, "assistant", "B.")] + [(80, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'k' AS kind", "'s' AS signature", "1 AS facts", "'a' AS audit", "true AS dropped").repartition(5)
    got = {x.conv_id: tuple(x[c] for c in FACTS) for x in repair.repair_report(table).collect()}
    assert got == brute(rows)
    body = repair.repaired(table).collect()
    for conv_id in (3, 80, None):
        own = sorted((x.position, f"{x.role}:{x.text}") for x in body if x.conv_id == conv_id)
        assert hashlib.sha256("\n".join(t for _, t in own).encode()).hexdigest() == got[conv_id][-1]


def test_conversation_that_loses_all_rows(spark):
    lost = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    got = repair.repair_report(spark.createDataFrame([(lost, 0, "user", "Gone.")], SCHEMA)).collect()
    assert [tuple(x) for x in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert repair.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_agrees_with_duckdb(spark, sf):
    import duckdb

    from lakewright.llm import queries

    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    result = connection.sql(queries.ORACLE_SQL["op12_conversation_repair"])
    names = result.columns
    assert sorted(tuple(x[c] for c in names) for x in queries.op12_conversation_repair(spark, sf).collect()) == sorted(result.fetchall())
