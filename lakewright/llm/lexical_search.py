"""Ranked lexical search over a clustered index, documents reordered by recursive graph bisection.

Index.  Recursive graph bisection halves a set of documents again and again so that the logarithmic gap cost of the terms'
postings in the two halves becomes small: documents move to the side where their terms are.  The top levels are fitted
on a bounded sample of documents and kept as a tree of term weights, one split per node, so any number of documents
is dealt to its leaves in one pass; a leaf is cut into parts of bounded size, and each part is bisected whole, inside one task,
down to shards of at most SHARD documents.  The sample shapes the shards only: every document with a term is indexed with all
its terms.  An index row is (shard, term, df, top, places, impacts): impacts are the term's exact contributions
before its weight, top is the largest of them.

Search.  A shard's bound for a query is the sum over the query's terms of weight times top.  Shards are visited
by falling bound, a few at first and eight times as many in each further round, until no unvisited shard's bound reaches the
score of the query's k-th best document.  Shards with an equal bound are still visited, so ties are exact too: places map back to
doc_id, and equal scores go by ascending doc_id.  Terms are compared as strings, never by hash.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import materialise, small, small_batches
from lakewright.llm.text import ALNUM, pieces
from lakewright.llm.worker import releasing

#: Documents and bytes a document of the sample that shapes the top of the tree, its leaves' documents, and its terms.
SAMPLE, SAMPLE_BYTES, LEAF, TREE_TERMS = 4096, 1 << 16, 32, 16_384
#: Documents of a shard; documents and postings of a part, which one task bisects.
SHARD, PART, PART_POSTINGS = 256, 4096, 4_000_000
#: Rounds of swaps at one level of the bisection.
SWAPS = 8
#: Postings that one step of arithmetic takes at a time.
STRIDE = 1 << 18
#: Shards that a query visits in its first round, and the factor of further rounds.
FIRST, MORE = 8, 8
#: Queries that one group of a visit serves.
QUERIES = 512
SCALE = 1_000_000_000


class Postings:
    """Distinct terms with their counts of some documents, in the order of the documents."""

    def __init__(self, terms: pa.Array, doc: np.ndarray, term: np.ndarray, count: np.ndarray, lengths: np.ndarray):
        self.terms, self.doc, self.term, self.count, self.lengths = terms, doc, term, count, lengths


def _counted(words: pa.Array, owner: np.ndarray, lengths: np.ndarray) -> Postings:
    found = words.dictionary_encode()
    width = max(len(found.dictionary), 1)
    pairs, count = np.unique(owner * width + found.indices.to_numpy().astype(np.int64), return_counts=True)
    return Postings(found.dictionary, pairs // width, pairs % width, count, lengths)


def tokenised(column: pa.Array) -> Iterator[Postings]:
    """Postings of a string column, piece by piece; a term keeps a line feed behind it, which no term holds."""
    for piece in pieces(column):
        starts, ends, first = piece.words(ALNUM, lower=True)
        to = np.cumsum(ends - starts + 1) if len(starts) else np.zeros(0, np.int64)
        data = np.full(int(to[-1]) if len(to) else 0, 0x0A, np.uint8)
        inside = np.ones(len(data), bool)
        inside[to - 1] = False
        data[inside] = piece.data[ALNUM[piece.data]]
        words = pa.Array.from_buffers(pa.large_binary(), len(to), [None, pa.py_buffer(np.r_[0, to].astype(np.int64)), pa.py_buffer(data)])
        lengths = np.diff(first)
        yield _counted(words, np.repeat(np.arange(len(piece)), lengths), lengths)


def _cost(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    return degree * np.log2(size / (degree + 1.0))


def _strides(count: int) -> Iterator[slice]:
    return (slice(lo, min(lo + STRIDE, count)) for lo in range(0, count, STRIDE))


def _grouped(of: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their groups, and where each group begins (one more at the end)."""
    return np.argsort(of.astype(np.int16) if groups < 1 << 15 else of, kind="stable"), np.r_[0, np.cumsum(np.bincount(of, minlength=groups))]


def _swapped(doc: np.ndarray, term: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The side of every document of one node; its arrays by posting have 32 bits, all others go by term, by document or by stride."""
    degree = np.bincount(term)
    key = (np.cumsum(degree > 0, dtype=np.int32) - 1)[term]
    total = degree[degree > 0]
    n0, n1 = max(int((~side).sum()), 1), max(int(side.sum()), 1)
    side = side.copy()
    for _ in range(SWAPS):
        right, gain = np.zeros(len(total), np.int64), np.zeros(len(side))
        for s in _strides(len(doc)):
            right += np.bincount(key[s][side[doc[s]]], minlength=len(total))
        left = total - right
        now = _cost(left, n0) + _cost(right, n1)
        to_right = now - _cost(np.maximum(left - 1, 0), n0) - _cost(right + 1, n1)
        to_left = now - _cost(left + 1, n0) - _cost(np.maximum(right - 1, 0), n1)
        for s in _strides(len(doc)):
            gain += np.bincount(doc[s], weights=np.where(side[doc[s]], to_left[key[s]], to_right[key[s]]), minlength=len(side))
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        pairs = min(len(a), len(b))
        a, b = (x[np.argsort(-gain[x], kind="stable")][:pairs] for x in (a, b))
        swap = gain[a] + gain[b] > 1e-9
        if not swap.any():
            break
        side[a[swap]], side[b[swap]] = True, False
    return side


def halved(doc: np.ndarray, term: np.ndarray, node: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The side (False: first half) of every document after swaps that lower the gap cost within its node.

    doc and term are postings; node and the initial side are by document.  Nodes are worked on one after the other.
    """
    nodes, side = int(node.max(initial=0)) + 1, side.copy()
    if nodes == 1:
        return _swapped(doc, term, side)
    postings, begin = _grouped(node.astype(np.int32)[doc], nodes)
    documents, first = _grouped(node, nodes)
    own = np.empty(len(node), np.int32)
    own[documents] = np.arange(len(node)) - np.repeat(first[:-1], np.diff(first))
    for v in range(nodes):
        mine, held = documents[first[v] : first[v + 1]], postings[begin[v] : begin[v + 1]]
        side[mine] = _swapped(own[doc[held]], term[held], side[mine])
    return side


def bisected(doc: np.ndarray, term: np.ndarray, documents: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, shard of each place): documents reordered by recursive graph bisection, cut into shards of at most stop."""
    shared = np.bincount(term) > 1 if len(term) else np.zeros(0, bool)
    keep = shared[term]
    doc, term = doc[keep].astype(np.int32, copy=False), term[keep].astype(np.int32, copy=False)
    order, node = np.arange(documents), np.zeros(documents, np.int64)
    while documents and np.bincount(node).max() > stop:
        place = np.empty(documents, np.int64)
        place[order] = np.arange(documents)
        size = np.bincount(node)
        begin = np.cumsum(size) - size
        side = place - begin[node] >= (size[node] + 1) // 2
        side = halved(doc, term, node, side)
        node = node * 2 + side
        order = np.lexsort((place, node))
        _, node = np.unique(node, return_inverse=True)
    return order, node[order]


class Tree:
    """Splits of the sample's bisection: node v sends a document left (2v) if its terms' weights sum to more than cut[v], else right."""

    def __init__(self, terms: pa.Array, weights: np.ndarray, cuts: np.ndarray):
        self.terms, self.weights, self.cuts = terms, weights, cuts

    def leaves(self, postings: Postings) -> np.ndarray:
        """The leaf of every document of postings."""
        documents = len(postings.lengths)
        node = np.ones(documents, np.int64)
        if len(self.cuts) < 2:
            return node
        row = pc.index_in(postings.terms.cast(pa.binary()), value_set=self.terms).fill_null(-1).to_numpy().astype(np.int64)[postings.term]
        known = row >= 0
        row, doc = row[known], postings.doc[known]
        while node[0] < len(self.cuts) if documents else False:
            score = np.bincount(doc, weights=self.weights[row, node[doc]], minlength=documents)
            node = 2 * node + (score <= self.cuts[node])
        return node

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, terms=np.frombuffer(b"".join(self.terms.to_pylist()), np.uint8), weights=self.weights, cuts=self.cuts)
        return out.getvalue()

    @staticmethod
    def loaded(data: bytes) -> Tree:
        parts = np.load(io.BytesIO(data))
        return Tree(_split_terms(parts["terms"]).cast(pa.binary()), parts["weights"], parts["cuts"])


def _split_terms(data: np.ndarray) -> pa.Array:
    """The terms of a buffer, each with its line feed."""
    ends = np.flatnonzero(data == 0x0A) + 1
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _blobs(column: pa.Array, whole: bool = False) -> list[memoryview]:
    """The values of a binary column without nulls, or all of them in one, as views of its buffer."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :]
    marks = offsets[[0, -1]] if whole else offsets
    data = memoryview(column.buffers()[2] or b"")
    return [data[lo:hi] for lo, hi in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True)]


def _fitted(texts: pa.Array) -> Tree:
    """The tree of a sample of texts."""
    postings = [p for p in tokenised(texts)]
    words = pa.chunked_array([p.terms.take(pa.array(p.term)) for p in postings] or [pa.array([], pa.large_binary())], pa.large_binary()).combine_chunks()
    base = np.cumsum([0, *(len(p.lengths) for p in postings)])
    owner = np.concatenate([p.doc + b for p, b in zip(postings, base, strict=False)]) if postings else np.zeros(0, np.int64)
    all_terms = _counted(words, owner, np.zeros(int(base[-1]), np.int64))
    holders = np.bincount(all_terms.term, minlength=len(all_terms.terms))
    kept = np.sort(np.argsort(-holders, kind="stable")[:TREE_TERMS])
    kept = kept[holders[kept] >= 4]
    number = np.full(len(holders), -1, np.int64)
    number[kept] = np.arange(len(kept))
    term = number[all_terms.term]
    doc, term = all_terms.doc[term >= 0], term[term >= 0]
    documents = int(base[-1])
    depth = max(0, int(np.log2(max(documents, 1) / LEAF)))
    weights, cuts = np.zeros((len(kept), 1 << depth), np.float32), np.zeros(1 << depth)
    node = np.ones(documents, np.int64)
    for level in range(depth if len(doc) else 0):
        local = node - (1 << level)
        order = np.argsort(local, kind="stable")
        begin = np.searchsorted(local[order], np.arange((1 << level) + 1))
        place = np.empty(documents, np.int64)
        place[order] = np.arange(documents)
        size = np.diff(begin)
        side = halved(doc, term, local, place - begin[local] >= (size[local] + 1) // 2)
        cell = term * (1 << level) + local[doc]
        right = np.bincount(cell, weights=side[doc], minlength=len(kept) << level).reshape(len(kept), -1)
        left = np.bincount(cell, minlength=len(kept) << level).reshape(len(kept), -1) - right
        n0, n1 = (np.maximum(np.bincount(local, weights=s, minlength=1 << level), 1) for s in (~side, side))
        own = (_cost(right + 1, n1) - _cost(right, n1) - _cost(left + 1, n0) + _cost(left, n0)).astype(np.float32)
        weights[:, 1 << level : 2 << level] = own
        score = np.bincount(doc, weights=own[term, local[doc]], minlength=documents)
        for v in range(1 << level):
            mine = score[local == v]
            cuts[(1 << level) + v] = np.median(mine) if len(mine) else 0
        node = 2 * node + (score <= cuts[node])
    used = all_terms.terms.take(pa.array(kept)).cast(pa.binary())
    return Tree(used, weights, cuts if len(doc) else np.zeros(1))


def sample_tree(docs: DataFrame) -> bytes:
    """The dumped tree of about SAMPLE documents of at most SAMPLE_BYTES bytes: at most 2 x SAMPLE go to one task, the tree (8 MB at most) comes back."""
    brief = docs.where(F.octet_length("text") <= SAMPLE_BYTES)
    total = brief.count()
    chosen = brief.select("text").sample(min(1.0, SAMPLE / max(total, 1)), 7) if total > SAMPLE else brief.select("text")

    @releasing
    def run(batches):
        texts = [b.column(0) for b in batches]
        tree = _fitted(pa.chunked_array(texts, pa.string()).combine_chunks() if texts else pa.array([], pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([tree.dumped()], pa.binary())], ["tree"])

    fitted = chosen.limit(2 * SAMPLE).coalesce(1).mapInArrow(run, "tree binary").first()
    return bytes(fitted[0]) if fitted else Tree(pa.array([], pa.binary()), np.zeros((0, 1), np.float32), np.zeros(1)).dumped()


class Index:
    """entries(shard, term, df, top, places, impacts), members(shard, ids), and the counts of documents and terms that impacts were made with."""

    def __init__(self, entries: DataFrame, members: DataFrame, documents: int):
        self.entries, self.members, self.documents = entries, members, documents


_DEALT = "leaf long, sub long, doc_id long, n long, terms binary, counts binary"
_ROWS = "shard long, term string, df long, top long, places binary, impacts binary, ids array<long>"


def _routed(docs: DataFrame, tree: bytes) -> DataFrame:
    """(leaf, n, postings) of every document with a term."""

    @releasing
    def run(batches):
        model = Tree.loaded(tree)
        for batch in batches:
            for p in tokenised(batch.column(0)):
                leaf, size = model.leaves(p), np.bincount(p.doc, minlength=len(p.lengths))
                keep = p.lengths > 0
                yield pa.RecordBatch.from_arrays([pa.array(leaf[keep]), pa.array(p.lengths[keep].astype(np.int64)), pa.array(size[keep].astype(np.int64))], ["leaf", "n", "postings"])

    return docs.select("text").mapInArrow(run, "leaf long, n long, postings long")


def _dealt(docs: DataFrame, tree: bytes, parts: dict[int, int]) -> DataFrame:
    """Every document with a term, its leaf and part, and its terms; documents of a leaf go round its parts."""

    @releasing
    def run(batches):
        model, turn = Tree.loaded(tree), dict.fromkeys(parts, 0)
        for batch in batches:
            at = 0
            for p in tokenised(batch.column(1)):
                ids, at = batch.column(0).slice(at, len(p.lengths)), at + len(p.lengths)
                leaf, sub = model.leaves(p), np.zeros(len(p.lengths), np.int64)
                for v in np.unique(leaf):
                    mine = np.flatnonzero(leaf == v)
                    sub[mine] = (turn.get(int(v), 0) + np.arange(len(mine))) % parts.get(int(v), 1)
                    turn[int(v)] = turn.get(int(v), 0) + len(mine)
                words = p.terms.take(pa.array(p.term))
                offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
                first = np.searchsorted(p.doc, np.arange(len(p.lengths) + 1))
                terms = pa.Array.from_buffers(pa.large_binary(), len(p.lengths), [None, pa.py_buffer(offsets[first]), words.buffers()[2]])
                counts = pa.Array.from_buffers(pa.large_binary(), len(p.lengths), [None, pa.py_buffer(first * 4), pa.py_buffer(p.count.astype(np.int32))])
                rows = pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(sub), ids, pa.array(p.lengths.astype(np.int64)), terms.cast(pa.binary()), counts.cast(pa.binary())], ["leaf", "sub", "doc_id", "n", "terms", "counts"])
                yield rows.filter(pa.array(p.lengths > 0))

    return docs.select("doc_id", "text").mapInArrow(run, _DEALT)


def _shards(held: list[pa.RecordBatch], number: int, documents: int, words: int, size: int) -> Iterator[pa.RecordBatch]:
    """Index rows of one part: its documents bisected and cut into shards of at most size.  Takes the batches out of held."""
    lengths, ids = (np.concatenate([b["n"].to_numpy() for b in held]), pa.chunked_array([b["doc_id"] for b in held]).combine_chunks())
    counts = [np.frombuffer(x, np.int32) for b in held for x in _blobs(b["counts"])]
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), [len(c) for c in counts])
    tf = np.concatenate(counts)
    found = pa.chunked_array([_split_terms(np.frombuffer(x, np.uint8)) for b in held for x in _blobs(b["terms"], whole=True)]).dictionary_encode()
    held.clear()
    del counts
    names, term = pc.binary_slice(found.chunk(0).dictionary.cast(pa.binary()), 0, -1), np.concatenate([c.indices.to_numpy() for c in found.chunks])
    del found
    order, shard = bisected(doc, term, len(lengths), size)
    place, of = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    first = np.searchsorted(shard, np.arange(int(shard[-1]) + 1))
    place[order], of[order] = np.arange(len(order)) - first[shard], shard
    m = 75 + 25 * lengths * documents // words
    postings, start = _grouped(of.astype(np.int32)[doc], len(first))
    for v in range(len(first)):
        for_shard = postings[start[v] : start[v + 1]]
        mine = for_shard[np.lexsort((place[doc[for_shard]], term[for_shard]))]
        key, own, times = term[mine], doc[mine], tf[mine].astype(np.int64)
        places, impact = place[own].astype(np.uint16), SCALE * times // (1000 * times + 12 * m[own])
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        blobs = np.r_[begin, len(key)]
        df, top = np.diff(blobs), np.maximum.reduceat(impact, begin)
        for lo in range(0, len(begin), 50_000):
            hi = min(lo + 50_000, len(begin))
            cut = blobs[lo : hi + 1]
            packed = [
                pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((cut - cut[0]) * bytes_each), pa.py_buffer(np.ascontiguousarray(values[cut[0] : cut[-1]]))]).cast(pa.binary())
                for values, bytes_each in ((places, 2), (impact.astype(np.int32), 4))
            ]
            text = names.take(pa.array(key[begin[lo:hi]])).cast(pa.string())
            empty = pa.nulls(hi - lo, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, (number << 16) + v)), text, pa.array(df[lo:hi].astype(np.int64)), pa.array(top[lo:hi].astype(np.int64)), *packed, empty], ["shard", "term", "df", "top", "places", "impacts", "ids"])
    ends = np.r_[first[1:], len(order)]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, ends[-1:]].astype(np.int32)), ids.take(pa.array(order)))
    nothing = [pa.nulls(len(first), t) for t in (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
    yield pa.RecordBatch.from_arrays([pa.array((number << 16) + np.arange(len(first))), *nothing, lists], ["shard", "term", "df", "top", "places", "impacts", "ids"])


def built(docs: DataFrame) -> Index:
    """The index of docs(doc_id, text)."""
    with small_batches(docs.sparkSession):
        return _built(docs)


def _built(docs: DataFrame) -> Index:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tree = sample_tree(docs)
    loads = _routed(docs, tree).groupBy("leaf").agg(F.count("*").alias("documents"), F.sum("n").alias("words"), F.sum("postings").alias("postings")).collect()  # a row a leaf
    documents, words = sum(r.documents for r in loads), sum(r.words for r in loads)
    parts = {r.leaf: max(-(-r.documents // PART), -(-r.postings // PART_POSTINGS)) for r in loads}
    before, numbers, size = 0, {}, SHARD
    for leaf in sorted(parts):
        numbers[leaf], before = before, before + parts[leaf]

    @releasing
    def run(batches):
        held, at = [], None
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            marks = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, len(batch)]
            for lo, hi in zip(marks[:-1], marks[1:], strict=True):
                if hi > lo:
                    own = (int(keys[0, lo]), int(keys[1, lo]))
                    if held and own != at:
                        yield from _shards(held, numbers[at[0]] + at[1], documents, words, size)
                    at = own
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from _shards(held, numbers[at[0]] + at[1], documents, words, size)

    dealt = _dealt(docs, tree, parts).repartition("leaf", "sub").sortWithinPartitions("leaf", "sub", "doc_id")
    rows = materialise(dealt.mapInArrow(run, _ROWS))
    return Index(rows.where("term IS NOT NULL").drop("ids"), rows.where("term IS NULL").select("shard", "ids"), documents)


def query_terms(items: DataFrame) -> DataFrame:
    """(query, item_id, term, times): the terms of every query with their repeats; query names an item row by its id and text."""

    @releasing
    def run(batches):
        for batch in batches:
            at = 0
            for p in tokenised(batch.column(2)):
                rows = pa.array(p.doc + at)
                at += len(p.lengths)
                term = pc.binary_slice(p.terms.cast(pa.binary()), 0, -1).cast(pa.string()).take(pa.array(p.term))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), term, pa.array(p.count.astype(np.int64))], ["query", "item_id", "term", "times"])

    keyed = items.select(F.sha2(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text"), 256).alias("query"), F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    return keyed.dropDuplicates(["query"]).mapInArrow(run, "query string, item_id long, term string, times long")


def _best_of_shards(needed: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(query, doc_id, score): the k best documents of every shard that a query visits.

    needed: shard, block, term, to(query, weight), places, impacts; a group (shard, block) holds one shard and at most about
    QUERIES queries.
    """
    groups = needed.select("shard", "block").distinct()
    heads = members.join(groups, "shard").select("shard", "block", F.lit(0).alias("kind"), "ids", F.lit(None).cast(needed.schema["to"].dataType).alias("to"), F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("impacts"))
    body = needed.select("shard", "block", F.lit(1).alias("kind"), F.lit(None).cast("array<long>").alias("ids"), "to", "places", "impacts")
    ready = heads.union(body).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")

    @releasing
    def run(batches):
        ids, rows, scores = [], {}, np.zeros((0, 0), np.int64)

        def best():
            names, empty = list(rows), np.array([x is None for x in ids])
            order = np.array([0 if x is None else x for x in ids], np.int64)
            queries, found, totals = [], [], []
            for name, score in zip(names, scores, strict=False):
                hit = np.flatnonzero(score > 0)
                for d in hit[np.lexsort((order[hit], empty[hit], -score[hit]))[:k]]:
                    queries.append(name)
                    found.append(ids[d])
                    totals.append(int(score[d]))
            return pa.RecordBatch.from_arrays([pa.array(queries, pa.string()), pa.array(found, pa.int64()), pa.array(totals, pa.int64())], ["query", "doc_id", "score"])

        for batch in batches:
            for kind, own, to, places, impacts in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                if kind == 0:
                    if rows:
                        yield best()
                    ids, rows, scores = own, {}, np.zeros((64, len(own)), np.int64)
                    continue
                at = np.array([rows.setdefault(t["query"], len(rows)) for t in to])
                if len(rows) > len(scores):
                    scores = np.concatenate([scores, np.zeros((max(len(scores), len(rows) - len(scores)), len(ids)), np.int64)])
                weight, impact = np.array([t["weight"] for t in to], np.int64), np.frombuffer(impacts, np.int32).astype(np.int64)
                scores[at[:, None], np.frombuffer(places, np.uint16)[None, :]] += weight[:, None] * impact[None, :]
        if rows:
            yield best()

    return ready.mapInArrow(run, "query string, doc_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def searched(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query, doc_id, score, rank) of the k best documents of every query of query_terms, and the visits (query, shard)."""
    queries = materialise(queries)
    wanted = small(materialise(queries.select("term").distinct()))
    held = index.entries.join(wanted, "term")
    frequency = held.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = materialise(queries.join(frequency, "term").select("query", "term", (weight * F.col("times")).alias("weight")).where("weight > 0"))
    bounds = index.entries.select("shard", "term", "top").join(small(weighted), "term").groupBy("query", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    left = materialise(bounds.where("bound > 0"))
    blocks = weighted.select("query").distinct().count() // QUERIES + 1
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    found, visits, width = None, None, FIRST
    while True:
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "shard")
        visit = materialise(left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width).select("query", "shard"))
        if not visit.limit(1).count():
            break
        to = visit.join(weighted, "query").groupBy("shard", block.alias("block"), "term").agg(F.collect_list(F.struct("query", "weight")).alias("to"))
        # few shards are visited in a round: the names of what is needed are small against the entries that they pick
        needed = index.entries.select("shard", "term", "places", "impacts").join(small(materialise(to), "size(to)"), ["shard", "term"])
        fresh = _best_of_shards(needed, index.members, k)
        with small_batches(queries.sparkSession):
            found = materialise(_top(fresh if found is None else found.select("query", "doc_id", "score").union(fresh), k))
        visits = visit if visits is None else visits.union(visit)
        last = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("last"))
        left = materialise(left.join(visit, ["query", "shard"], "left_anti").join(last, "query", "left").where("bound >= coalesce(last, 0)").select("query", "shard", "bound"))
        width *= MORE
    if found is None:
        found = queries.select("query", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)
        visits = queries.select("query", F.lit(0).cast("long").alias("shard")).limit(0)
    return found, visits


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of docs(doc_id, text) for every row of items(item_id, text).

    Documents score above 0 or are left out; equal scores go by ascending doc_id, rows without one last.  Null and empty texts have no
    terms: they find nothing and are not found.  Rows of docs that repeat a doc_id are documents of their own.  Rows of items
    that are equal are one query; those that share an item_id under different texts are ranked each for itself.  Empty tables
    give no rows; other columns are not read.
    """
    terms = materialise(query_terms(items))
    found, _ = searched(built(docs), terms.select("query", "term", "times"), k)
    names = terms.select("query", "item_id").distinct()
    return found.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
