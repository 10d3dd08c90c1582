"""Conversation structure repair by dynamic programming over a prefix trie of signatures.

A conversation's signature has one letter per row: its role's initial (s, u, a, or x for any other), capital if the text is
truncated, or - if the row must go (blank or duplicate).  Role and fault are all that the cheapest edits depend on, so equal
signatures are solved once, and sorted signatures share prefixes: they are the paths of a trie that is walked in order,
holding one layer of the dynamic programme (the least cost to reach each state of the role pattern) per node of the
current path.  A shared prefix is computed once; at a terminal node the answer is read off the path's layers.

Conversations are never held as one value: rows are sorted within partitions and streamed, once for the signatures and
once more to apply the answers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import join_hot, materialise

#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a; the first and the last may end it.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_FAR = 1 << 60
#: Where an inserted or changed row leads, and its role.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_FITS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
_SPACE = " \\u0009\\u000A\\u000B\\u000C\\u000D"


def _edges(letter: str) -> list[tuple[int, str, int, int]]:
    """(state, edit, next state, cost) of one row."""
    out = [(q, "D", q, DELETE) for q in range(4)]
    if letter != "-":
        extra = TRUNCATED if letter.isupper() else 0
        out += [(q, "K", to, KEEP + extra) for q, to in _FITS[letter.lower()].items()]
        out += [(q, "R", to, REROLE + extra) for q, to in _NEXT.items()]
    return out


EDGES = {letter: _edges(letter) for letter in "suaxSUAX-"}


def _with_inserts(costs: list[int]) -> list[int]:
    costs[USER] = min(costs[USER], min(costs[START], costs[SYSTEM], costs[ASSISTANT]) + INSERT)
    costs[ASSISTANT] = min(costs[ASSISTANT], costs[USER] + INSERT)
    return costs


def first_layer() -> list[int]:
    return _with_inserts([0, _FAR, _FAR, _FAR])


def next_layer(before: list[int], letter: str) -> list[int]:
    """The layer of a child in the trie: the least cost of each state after one more row and the insertions behind it."""
    costs = [_FAR] * 4
    for q, _, to, cost in EDGES[letter]:
        costs[to] = min(costs[to], before[q] + cost)
    return _with_inserts(costs)


def answer(path: list[list[int]], signature: str) -> tuple[int, str]:
    """(cost, audit) at a terminal node from its path's layers: of the cheapest edits the ASCII-least initials."""
    total = min(path[-1][q] for q in ACCEPTING)
    marks = [0] * len(path)  # the states of each layer that cheapest edits pass, as bits
    marks[-1] = sum(1 << q for q in ACCEPTING if path[-1][q] == total)
    for i in range(len(path) - 1, -1, -1):
        at, found = path[i], marks[i]
        for to, sources in ((ASSISTANT, (USER,)), (USER, (START, SYSTEM, ASSISTANT))):
            if found >> to & 1:
                for q in sources:
                    if at[q] + INSERT == at[to]:
                        found |= 1 << q
        marks[i] = found
        if i:
            for q, _, to, cost in EDGES[signature[i - 1]]:
                if found >> to & 1 and path[i - 1][q] + cost == at[to]:
                    marks[i - 1] |= 1 << q
    edits, i, q = [], 0, START
    while i < len(signature) or not (q in ACCEPTING and path[i][q] == total):
        best = None
        if i < len(signature):
            for p, edit, to, cost in EDGES[signature[i]]:
                if p == q and marks[i + 1] >> to & 1 and path[i][q] + cost == path[i + 1][to] and (best is None or edit < best[0]):
                    best = (edit, i + 1, to)
        to = _NEXT[q]
        if marks[i] >> to & 1 and path[i][q] + INSERT == path[i][to] and (best is None or best[0] > "I"):
            best = ("I", i, to)
        edit, i, q = best
        edits.append(edit)
    return total, "".join(edits)


def solved(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of signatures; the more of a prefix they share with the one before, the less is computed."""
    path, before = [first_layer()], ""
    for signature in signatures:
        shared = 0
        for x, y in zip(before, signature, strict=False):
            if x != y:
                break
            shared += 1
        del path[shared + 1 :]
        for letter in signature[shared:]:
            path.append(next_layer(path[-1], letter))
        before = signature
        yield signature, *answer(path, signature)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows after the damage that crc32 of conv_id:turn names; dropped ones stay, marked."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


_FACTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def signatures(rows: DataFrame) -> DataFrame:
    """Counts of faults and the signature of every conversation of damaged rows."""
    last = F.expr(f"right(TRIM(TRAILING '{_SPACE}' FROM text), 1)")
    flagged = rows.select("conv_id", "dropped", "turn", "role", "text", F.left("role", F.lit(1)).alias("initial"), last.alias("last"), F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"))
    ready = flagged.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def run(batches):
        conversation, done, state = (), [], None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "dropped", "turn", "initial", "last", "digest")]
            for conv_id, dropped, turn, initial, last, digest in zip(*columns, strict=True):
                if conversation != (conv_id,):
                    if state:
                        done.append(state.facts())
                    conversation, state = (conv_id,), _Faults(conv_id)
                if not dropped:
                    state.add(turn, initial, last, digest)
            if len(done) > 5000:
                yield _batch(done)
                done = []
        if state:
            done.append(state.facts())
        yield _batch(done)

    def _batch(done: list[dict]) -> pa.RecordBatch:
        kinds = [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), ("signature", pa.string())]
        return pa.RecordBatch.from_pylist(done, pa.schema(kinds))

    return ready.drop("role", "text").mapInArrow(run, _FACTS)


class _Faults:
    """Faults of one conversation, row by row in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.seen, self.letters = conv_id, set(), []
        self.first = self.turn = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, last: str, digest: bytes) -> None:
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        letter = initial if initial in ("s", "u", "a") else "x"
        if not last:
            self.blank, letter = self.blank + 1, "-"
        elif digest in self.seen:
            self.duplicate, letter = self.duplicate + 1, "-"
        elif last not in ".!?":
            self.truncated, letter = self.truncated + 1, letter.upper()
        self.seen.add(digest)
        self.letters.append(letter)

    def facts(self) -> dict:
        gaps = self.turn - self.first + 1 - self.turns if self.first is not None else 0
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "signature": "".join(self.letters)}


def answers(facts: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct signatures, each range of them a trie of its own."""

    def run(batches):
        def each():
            for batch in batches:
                yield from batch.column(0).to_pylist()

        rows, size = [], 0
        for row in solved(each()):
            rows.append(row)
            size += len(row[0])
            if size > 4_000_000 or len(rows) > 20_000:
                yield _answer_batch(rows)
                rows, size = [], 0
        yield _answer_batch(rows)

    return facts.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(run, "signature string, cost long, audit string")


def _answer_batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["signature", "cost", "audit"])


def lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation: the audit applied to the rows."""
    state = START
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            yield _ROLE[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = _FITS[role[:1]][state]
            yield role, text
        elif edit == "R":
            state = _NEXT[state]
            yield _ROLE[state], text


def _streamed(rows: DataFrame, solved_facts: DataFrame) -> DataFrame:
    """rows and facts of each conversation, the facts first, sorted within partitions by conversation and row."""
    facts = solved_facts.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost").alias("facts"), "audit")
    body = rows.where("NOT dropped").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast(facts.schema["facts"].dataType).alias("facts"), F.lit(None).cast("string").alias("audit"))
    return facts.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text")


def _events(batches, columns: tuple[str, ...]):
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def _conversations(batches):
    """(conv_id, facts, audit, iterator of (role, text)) of each conversation of a stream; the iterator is to be used up first."""
    events = _events(batches, ("conv_id", "kind", "facts", "audit", "role", "text"))
    held = next(events, None)

    def rows():
        nonlocal held
        while (held := next(events, None)) and held[1] == 1:
            yield held[4], held[5]

    while held:
        body = rows()
        yield held[0], held[2], held[3], body
        for _ in body:
            pass


def _solved_rows(conversations: DataFrame) -> DataFrame:
    rows = damaged(conversations)
    facts = materialise(signatures(rows))
    return _streamed(rows, join_hot(facts, materialise(answers(facts)), "signature", "conv_id"))


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations, positions from 0; see repair_report for the cases."""

    def run(batches):
        out, size = [], 0
        for conv_id, _, audit, rows in _conversations(batches):
            for position, (role, text) in enumerate(lines(audit, rows)):
                out.append({"conv_id": conv_id, "position": position, "role": role, "text": text})
                size += len(text)
                if len(out) > 5000 or size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return _solved_rows(conversations).mapInArrow(run, "conv_id long, position long, role string, text string")


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage.

    Nulls in role and text are one space, as are nulls of conv_id and turn in the key of the damage; rows without a conv_id
    are one conversation of their own.  Rows go by turn, nulls first; rows of one turn by role and text, so a repeated
    row lies beside its copy.  A conversation that loses all rows has zeros, an empty audit and the hash of an empty string.
    Equal rows are duplicates of the first; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        done = []
        for conv_id, facts, audit, rows in _conversations(batches):
            digest = hashlib.sha256()
            for k, (role, text) in enumerate(lines(audit, rows)):
                digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
            done.append({"conv_id": conv_id, **facts, "audit": audit, "repaired_sha256": digest.hexdigest()})
            if len(done) > 5000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        yield pa.RecordBatch.from_pylist(done, schema)

    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _REPORT), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return _solved_rows(conversations).mapInArrow(run, f"conv_id long, {', '.join(f'{c} long' for c in _REPORT)}, audit string, repaired_sha256 string")
