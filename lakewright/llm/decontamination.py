"""Benchmark decontamination with an FM-index per training shard.

A shard is a piece of a partition (a few MB of whole documents).  Words that no test
phrase holds cannot be part of a match: they, and runs too short for the shortest
phrase, are left out of the shard's symbol sequence.  The rest is indexed: suffix array,
Burrows-Wheeler transform, a wavelet matrix with rank, and suffix positions sampled
every SAMPLE symbols.  All phrases are searched backwards at once, occurrences are
located by walking to a sampled position, and the spans of a document are merged.

The test phrases are the query side: they are taken in blocks of bounded size, each of
which is one more pass over the rows; the rows are written between passes, so any number of items works with one block in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import materialise
from lakewright.llm.text import ALNUM, pieces
from lakewright.llm.worker import releasing

WINDOW = 10
SAMPLE = 8
#: Bytes of benchmark text searched in one pass; more items are searched in further passes.
BLOCK_BYTES = 8 << 20


class FMIndex:
    """Index over a sequence of symbols 1..sigma-1; 0 is kept for the end."""

    def __init__(self, symbols: np.ndarray):
        text = np.r_[symbols.astype(np.int64), 0]
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (n + 1) + second
            self_order = np.argsort(key, kind="stable")
            ordered = key[self_order]
            fresh = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
            rank[self_order] = fresh
            if fresh[-1] == n - 1:
                break
            step *= 2
        suffix = self_order
        self.last = text[suffix - 1]  # the Burrows-Wheeler transform
        sigma = int(text.max()) + 1
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]  # symbols smaller than c
        self.levels = []
        row = self.last
        for bit in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            ones = (row >> bit) & 1
            zeros = np.r_[0, np.cumsum(1 - ones)]
            self.levels.append((bit, zeros, int(zeros[-1])))
            row = np.r_[row[ones == 0], row[ones == 1]]
        sampled = suffix % SAMPLE == 0
        self.is_sample = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = suffix[sampled]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[k] among the first i[k] symbols of the transform."""
        low, high = np.zeros_like(i), i
        for bit, zeros, total in self.levels:
            one = (c >> bit) & 1 == 1
            low0, high0 = zeros[low], zeros[high]
            low = np.where(one, total + low - low0, low0)
            high = np.where(one, total + high - high0, high0)
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of equal-length phrases: (row, first, one past the last) of those whose suffix range is not empty."""
        row = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[row, k]
            known = c < len(self.before) - 1
            row, low, high, c = row[known], low[known], high[known], c[known]
            low, high = self.before[c] + self.rank(c, low), self.before[c] + self.rank(c, high)
            left = low < high
            row, low, high = row[left], low[left], high[left]
        return row, low, high

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes with the given ranks."""
        i, walked, out = i.copy(), np.zeros(len(i), np.int64), np.empty(len(i), np.int64)
        open_ = np.arange(len(i))
        while len(open_):
            at = i[open_]
            done = self.is_sample[at]
            out[open_[done]] = self.samples[self.sample_rank[at[done]]] + walked[open_[done]]
            open_, at = open_[~done], at[~done]
            c = self.last[at]
            i[open_] = self.before[c] + self.rank(c, at)
            walked[open_] += 1
        return out


class Phrases:
    """The distinct windows of some benchmark items, as rows of word numbers by length."""

    def __init__(self, ids: list, texts: list, window: int):
        windows: dict[tuple, set[int]] = {}
        self.ids = ids
        at = 0
        for piece in pieces(pa.array(texts, pa.string())):
            hashes, first = piece.word_hashes(ALNUM, lower=True)
            for k in range(len(piece)):
                words = hashes[first[k] : first[k + 1]].tolist()
                n = min(window, len(words))
                for i in range(len(words) - n + 1 if n else 0):
                    windows.setdefault(tuple(words[i : i + n]), set()).add(at + k)
            at += len(piece)
        self.vocabulary = np.array(sorted({w for x in windows for w in x}), np.uint64)
        self.shortest = min(map(len, windows), default=0)
        self.groups = []
        for n in sorted({len(x) for x in windows}):
            rows = [x for x in windows if len(x) == n]
            owners = [sorted(windows[x]) for x in rows]
            symbols = np.searchsorted(self.vocabulary, np.array(rows, np.uint64)).astype(np.int64) + 2
            self.groups.append((n, symbols, np.concatenate([np.array(o) for o in owners]), np.r_[0, np.cumsum([len(o) for o in owners])]))

    def find(self, column: pa.Array) -> tuple[np.ndarray, list[list], list[list]]:
        """Words, merged spans (start and end of words, flat) and item ids of every text."""
        counts, spans, items = [], [], []
        for piece in pieces(column):
            hashes, first = piece.word_hashes(ALNUM, lower=True)
            counts.append(np.diff(first))
            n = len(piece)
            own_spans, own_items = [[] for _ in range(n)], [set() for _ in range(n)]
            doc = np.repeat(np.arange(n), np.diff(first))
            for start, length, phrase, owners, begin in self._hits(hashes, doc, first):
                at = doc[start]
                order = np.lexsort((start, at))
                at, start, phrase = at[order], start[order] - first[at[order]], phrase[order]
                for lo, hi in _groups(at):
                    d = int(at[lo])
                    own_spans[d] += _runs(start[lo:hi], length)
                    for f in np.unique(phrase[lo:hi]).tolist():  # each phrase's items once per document
                        own_items[d].update(owners[begin[f] : begin[f + 1]].tolist())
            spans += [_merge(s) for s in own_spans]
            items += [[self.ids[i] for i in sorted(s) if self.ids[i] is not None] for s in own_items]
        return (np.concatenate(counts) if counts else np.zeros(0, np.int64)), spans, items

    def _hits(self, hashes: np.ndarray, doc: np.ndarray, first: np.ndarray):
        """By phrase length: start word and phrase of every occurrence, the length, and the phrases' items (owners[begin[f] : begin[f + 1]])."""
        if not len(self.vocabulary) or not len(hashes):
            return
        symbol = np.searchsorted(self.vocabulary, hashes)
        symbol[symbol == len(self.vocabulary)] = 0
        known = self.vocabulary[symbol] == hashes
        # runs of known words within a document
        starts = known.copy()
        starts[1:] &= ~(known[:-1] & (doc[1:] == doc[:-1]))
        run = np.cumsum(starts) - 1
        lengths = np.bincount(run[known], minlength=int(run[-1]) + 1) if known.any() else np.zeros(0, np.int64)
        keep = np.flatnonzero(known)
        keep = keep[lengths[run[keep]] >= self.shortest]
        if not len(keep):
            return
        # one separator (symbol 1) before every run; shards hold words in order
        border = np.r_[True, run[keep][1:] != run[keep][:-1]]
        at = np.arange(len(keep)) + np.cumsum(border)
        sequence = np.ones(len(keep) + int(border.sum()), np.int64)
        sequence[at] = symbol[keep] + 2
        word = np.zeros(len(sequence), np.int64)
        word[at] = keep
        index = FMIndex(sequence)
        for n, phrases, owners, begin in self.groups:
            row, low, high = index.search(phrases)
            if not len(row):
                continue
            many = high - low
            which = np.repeat(np.arange(len(row)), many)
            ranks = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + low[which]
            yield word[index.locate(ranks)], n, row[which], owners, begin


def _groups(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    marks = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return list(zip(marks.tolist(), np.r_[marks[1:], len(values)].tolist(), strict=True))


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans of the words in occurrences of one length, by ascending start; overlapping ones are one."""
    cut = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + length])
    return list(zip(starts[cut].tolist(), (starts[np.r_[cut[1:], len(starts)] - 1] + length).tolist(), strict=True))


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def removal_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (array of word starts and ends, flat and merged) and items (array of strings).

    Words are runs of digits, letters and non-ASCII after lower-casing A-Z; an item matches where
    `window` of its consecutive words occur, or all of them if it has fewer.  Null texts have no words
    and empty items no windows; an item without an id is found but not listed; repeated items are listed
    once.  Every row of docs is judged alone, whatever its doc_id; columns of docs that are named
    n_words, spans or items are replaced.
    """
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in kept), "n_words long, spans array<int>, items array<string>"])
    out = docs.select(*kept, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for block in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().collect()
        phrases = Phrases([r.item_id for r in rows], [r.text for r in rows], window)
        sent = docs.sparkSession.sparkContext.broadcast(phrases)
        out = out.mapInArrow(_searcher(sent, kept.index("text"), len(kept)), schema)
        if block + 1 < blocks:
            out = materialise(out)  # one block of phrases in memory at a time
    return out


def _searcher(sent, text: int, width: int):
    @releasing
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                counts, spans, items = sent.value.find(part.column(text))
                old_spans, old_items = part.column(width + 1).to_pylist(), part.column(width + 2).to_pylist()
                spans = [_merge([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]) if a and b else a or b for a, b in zip(spans, old_spans, strict=True)]
                items = [sorted({*a, *b}) for a, b in zip(items, old_items, strict=True)]
                arrays = [*(part.column(i) for i in range(width)), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = removal_spans(docs.select("doc_id", "text"), benchmark, window).drop("text")
    hit = F.aggregate("spans", F.struct(F.lit(0).alias("sign"), F.lit(0).cast("long").alias("sum")), lambda a, x: F.struct((1 - a["sign"]).alias("sign"), (a["sum"] + F.when(a["sign"] == 0, -x).otherwise(x)).alias("sum")))["sum"]
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with the columns of docs."""
    return removal_spans(docs, benchmark, window).where(F.size("spans") == 0).select(*docs.columns)
