"""Exact substring removal by difference-cover anchors.

D is a difference cover modulo v: for any two positions i and j some shift below v puts
both i + shift and j + shift on positions whose remainder is in D.  So two equal windows
of w words share an equal anchor of w - v + 1 words that starts at a cover position of
both documents, at the same distance from the windows' starts.

1. Exact copies of a smaller document go whole; what they repeat stands in the first of them too,
   so no other document needs them.
2. Only anchors at cover positions are hashed and shuffled (4 of 13 positions for 20 words);
   those that occur once are dropped.
3. Around every repeated anchor the windows that contain it are hashed: each true repeat
   is among them.  A window that is not the first of its hash is marked.
4. Marks go back to their documents, whose words are kept or removed.

All steps on texts read one shuffle of them, by document.  Before a shuffle by hash a task keeps one entry
of each hash (see `_entries`), so that a passage of very many documents is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import join_hot, materialise, small
from lakewright.llm.text import NON_SPACE, gram_hashes, mix, pieces

#: Perfect difference sets, period -> remainders.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


#: Stands for a null doc_id: the smallest one.
NO_ID = -(2**63)


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The period whose anchors keep at least two fifths of the window."""
    period = max(p for p in COVERS if p == 1 or 5 * (window - p + 1) >= 2 * window)
    return period, COVERS[period]


#: Entries of a task that are combined before a shuffle.
RUN = 1 << 21


def _entries(keys: list[str], hashes: list[str], found: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Record batches (*keys, *hashes, pos, many, also) of the entries in `found`: arrays of key values, hashes and positions; no entry repeats.

    Of the entries with equal hashes in a run of RUN of them only the first by keys and position gets a row of its own, where `many` says
    that it has others.  These are lists of positions by document (`also`), dealt by document: so equal hashes have one row a run at most.
    Rows stay in the order of the documents, in which shuffle files compress best.
    """
    names = [*keys, *hashes, "pos", "many", "also"]

    def batches(run: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*run, strict=True)]
        ids, marks, pos = columns[: len(keys)], columns[len(keys) : -1], columns[-1]
        order = np.lexsort((pos, *reversed(ids), *reversed(marks)))
        new = np.r_[True, np.any([c[order[1:]] != c[order[:-1]] for c in marks], axis=0)]
        first, rest = order[new], np.sort(order[~new])
        many = np.zeros(len(pos), bool)
        many[first] = np.r_[~new[1:], False][new]
        first.sort()
        for i in range(0, len(first), 100_000):
            at = first[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in (*columns, many)), pa.nulls(len(at), pa.list_(pa.int32()))], names)
        if not len(rest):
            return
        ids, pos = [c[rest] for c in ids], pos[rest]
        begins = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in ids], axis=0)])
        for i in range(0, len(begins), 1000):
            at = begins[i : i + 1000]
            ends = np.r_[at, begins[i + 1000] if i + 1000 < len(begins) else len(pos)]
            also = pa.ListArray.from_arrays(pa.array((ends - at[0]).astype(np.int32)), pa.array(pos[at[0] : ends[-1]]))
            spread = mix(ids[0][at].view(np.uint64))
            dealt = [spread.astype(c.dtype) if c.dtype == np.int32 else spread.view(np.int64) for c in marks]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in ids), *map(pa.array, dealt), pa.nulls(len(at), pa.int32()), pa.array(np.ones(len(at), bool)), also], names)

    run, size = [], 0
    for entries in found:
        run.append(entries)
        size += len(entries[0])
        if size >= RUN:
            yield from batches(run)
            run, size = [], 0
    if run:
        yield from batches(run)


def _anchors(docs: DataFrame, keys: list[str], window: int) -> DataFrame:
    period, cover = cover_for(window)
    length = window - period + 1
    member = np.isin(np.arange(period), cover)

    def found(batches):
        for batch in batches:
            values = [batch.column(i).to_numpy() for i in range(len(keys))]
            for piece in pieces(batch.column(len(keys))):
                words, first = piece.word_hashes(NON_SPACE)
                counts = np.diff(first)
                doc = np.repeat(np.arange(len(piece)), counts)
                pos = np.arange(len(words)) - first[doc]
                keep = np.flatnonzero(member[pos % period] & (pos + length <= counts[doc]) & (counts[doc] >= window))
                if len(keep):
                    yield [*(v[piece.first + doc[keep]] for v in values), gram_hashes(words, length)[keep].view(np.int64), pos[keep].astype(np.int32)]

    return docs.select(*keys, "text").mapInArrow(lambda batches: _entries(keys, ["h"], found(batches)), _schema(keys, "h long"))


def _schema(keys: list[str], hashes: str) -> str:
    """Keys first: they repeat from row to row, so that shuffle compression needs one match a row."""
    return f"{', '.join(f'{k} long' for k in keys)}, {hashes}, pos int, many boolean, also array<int>"


def _two_hashes(words: np.ndarray, window: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the windows at keep: words go by them, and 64 bits would meet by chance in the windows of 100 TB."""
    return gram_hashes(words, window)[keep].view(np.int64), gram_hashes(mix(words), window)[keep].astype(np.int32)


def _windows(docs: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Entries of the windows that contain a repeated anchor; docs: keys, text, at (anchor positions)."""
    period, _ = cover_for(window)

    def found(batches):
        for batch in batches:
            values = [batch.column(i).to_numpy() for i in range(len(keys))]
            lists = batch.column(len(keys) + 1)
            lengths = lists.value_lengths().to_numpy()
            flat, begin = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lengths)]
            for piece in pieces(batch.column(len(keys))):
                words, first = piece.word_hashes(NON_SPACE)
                lo, hi = begin[piece.first], begin[piece.first + len(piece)]
                doc = np.repeat(np.arange(len(piece)), lengths[piece.first : piece.first + len(piece)])
                # anchor positions -> the starts of windows that hold them, as a difference array over all words
                change = np.zeros(len(words) + 1, np.int32)
                at = flat[lo:hi]
                np.add.at(change, first[doc] + np.maximum(0, at - (period - 1)), 1)
                np.add.at(change, first[doc] + at + 1, -1)
                starts = np.cumsum(change[:-1]) > 0
                owner = np.repeat(np.arange(len(piece)), np.diff(first))
                pos = np.arange(len(words)) - first[owner]
                keep = np.flatnonzero(starts & (pos + window <= np.diff(first)[owner]))
                if len(keep):
                    yield [*(v[piece.first + owner[keep]] for v in values), *_two_hashes(words, window, keep), pos[keep].astype(np.int32)]

    return docs.select(*keys, "text", "at").mapInArrow(lambda batches: _entries(keys, ["h", "h2"], found(batches)), _schema(keys, "h long, h2 int"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")


def _copies(texts: DataFrame, keys: list[str], window: int) -> DataFrame:
    """(*keys) of the texts of window words or more that equal one with smaller keys, by 128 bits; shorter texts may be among them."""
    prints = texts.where(F.length("text") >= 2 * window - 1).select(*keys, F.md5("text").alias("print"))
    groups = materialise(prints.groupBy("print").agg(F.min(F.struct(*keys)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return materialise(join_hot(prints, groups, "print", "did").where(F.struct(*keys) > F.col("first")).select(*keys).distinct())


def _positions(name: str) -> F.Column:
    return F.concat(F.collect_set("pos"), F.flatten(F.collect_list("also"))).alias(name)


def _marked(docs: DataFrame, window: int) -> DataFrame:
    """The keyed docs, shuffled by document, with `gone`: the starts of their windows that start earlier too (or null), and `copy`: all do."""
    keyed = _keyed(docs)
    # doc_id alone names a document, unless some are repeated
    several = keyed.groupBy("did").count().where("count > 1").limit(1).count()
    keys = ["did", "mark"] if several else ["did"]
    by_doc = keyed.select(*keys, "text").repartition(*keys)  # the same columns for all readers, so that they share the shuffle
    once = by_doc.dropDuplicates(keys) if several else by_doc
    copies = small(_copies(keyed, keys, window))
    anchors = _anchors((once if several else keyed).join(copies, keys, "left_anti"), keys, window)
    repeated = anchors.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1 or many")
    places = repeated.groupBy(*keys).agg(_positions("at"))
    windows = _windows(once.join(places, keys), keys, window).withColumn("sure", F.col("also").isNotNull())
    later = windows.withColumn("rank", F.rank().over(Window.partitionBy("h", "h2", "sure").orderBy(*keys, "pos"))).where("rank > 1 or sure")
    gone = later.groupBy(*keys).agg(_positions("gone"))
    return by_doc.join(gone, keys, "left").join(copies.withColumn("copy", F.lit(True)), keys, "left")


def _kept(text: str | None, gone: list | None, copy: bool | None, window: int) -> tuple[int, int, bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if copy and len(words) >= window:
        return len(words), len(words), b""
    if gone is None:
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + window + 1, np.int32)
    starts = np.asarray(gone)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    drop = (np.cumsum(change) > 0)[: len(words)]
    return len(words), int(drop.sum()), b" ".join(w for w, d in zip(words, drop.tolist(), strict=True) if not d)


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, text) for every row of docs(doc_id, text): text is what stays, words joined by one space.

    A window of `window` consecutive words goes if its sequence also starts earlier: in a smaller doc_id
    or before it in the same document; windows are judged on the input.  Null texts have no words.  A null
    doc_id counts as the smallest one.  Rows with one doc_id and different texts are different documents,
    in the order of a hash of their texts; rows that are wholly equal are one document and are not removed
    against each other.  Other columns of docs are not read.
    """
    return _finish(docs, window, False)


def substring_dedup_digests(docs: DataFrame, window: int = 20) -> DataFrame:
    """substring_dedup with kept_sha256, the digest of the kept text, in place of the text."""
    return _finish(docs, window, True)


def _finish(docs: DataFrame, window: int, digest: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                rows = [_kept(t.as_py(), g.as_py(), c.as_py(), window) for t, g, c in zip(part.column(1), part.column(2), part.column(3), strict=True)]
                text = [hashlib.sha256(x[2]).hexdigest() if digest else x[2].decode("utf-8", "surrogatepass") for x in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array(text, pa.string())], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "text"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = F.when(F.col("did") != NO_ID, F.col("did")).cast(kind).alias("doc_id")
    return _marked(docs, window).select(own, "text", "gone", "copy").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, {names[3]} string")
