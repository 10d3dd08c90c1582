"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits: bit k is 1 if more than half of its shingles' hashes have it.  Fingerprints
link if they differ in three bits or fewer.  To find the links, a fingerprint is cut into segments of 21, 21 and 22
bits, and a segment, as a word of the perfect binary (23, 12) Golay code, is decoded to the indices of codewords near it:

* near(2): the codewords that the word or any word one bit away decodes to (1 or 6 of them).  Two words that differ in two
  bits or fewer share one: the word between them decodes to it;
* near(1): of these the word's own and those of a larger index (3 on average).  Two words that differ in one bit share one:
  if they decode to different codewords, each sees the other's, and the larger is kept by both.

Pigeonhole over the segments: of three errors either one segment has none, or every segment has one at most.

* no error in segment i: either the next segment has two errors at most, and (i whole, near(2) of i + 1) is shared, or it
  has all three, and then (i + 2 whole, near(2) of i) is;
* one at most in each: (near(1) of segment 0, near(1) of segment 1, one half of segment 2) is shared, as one half has none.

So no link is lost, and every key has 33 bits or more.  Equal fingerprints are one node.  The members of a key are first
verified against its smallest one; only members in other components than the key's largest are then compared with all
members, in blocks of bounded size, and what is sent on are links of components and not of members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import connected_components, join_hot, materialise
from lakewright.llm.text import NON_SPACE, Piece, pieces

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Generator polynomial of the code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
#: First bit and bits of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Members of a key in one block.
BLOCK = 4096
_CHUNK = 1 << 18


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of every 12-bit message (shifted by 11) by the generator, and the error of every syndrome."""
    rest = np.zeros(4096, np.uint32)
    for message in range(4096):
        r = message << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        rest[message] = r
    error = np.zeros(2048, np.uint32)
    for weight in range(4):
        for at in combinations(range(23), weight):
            e = sum(1 << b for b in at)
            error[int(rest[e >> 11]) ^ (e & 2047)] = e
    return rest, error


_REST, _ERROR = _code_tables()
_FLIPS = np.array([0] + [1 << b for b in range(23)], np.uint32)


def decoded(words: np.ndarray) -> np.ndarray:
    """Index of the one codeword within three bits of every 23-bit word."""
    return (words ^ _ERROR[_REST[words >> np.uint32(11)] ^ (words & np.uint32(2047))]) >> np.uint32(11)


def near_codes(words: np.ndarray, errors: int) -> np.ndarray:
    """near(errors) of every word, six columns, -1 where a word has fewer."""
    codes = decoded(words[:, None] ^ _FLIPS[None, :]).astype(np.int64)
    own = codes[:, :1].copy()
    codes.sort(axis=1)
    keep = np.ones(codes.shape, bool)
    keep[:, 1:] = codes[:, 1:] != codes[:, :-1]
    if errors == 1:
        keep &= codes >= own
    out = np.full((len(words), 6), -1, np.int64)
    row, column = np.nonzero(keep)
    out[row, (np.cumsum(keep, axis=1) - 1)[row, column]] = codes[row, column]
    return out


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) rows of uint64 fingerprints."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.uint32) for at, bits in SEGMENTS]
    rows, keys = [], []

    def add(family: int, codes: np.ndarray, exact: np.ndarray) -> None:
        row, column = np.nonzero(codes >= 0)
        rows.append(row)
        keys.append((np.int64(family) << 60) | (codes[row, column] << 24) | exact.astype(np.int64)[row])

    for i in range(3):
        add(i, near_codes(parts[(i + 1) % 3], 2), parts[i])
    a, b = near_codes(parts[0], 1), near_codes(parts[1], 1)
    both = np.where((a[:, :, None] >= 0) & (b[:, None, :] >= 0), (a[:, :, None] << 12) | b[:, None, :], -1).reshape(len(prints), 36)
    for half in range(2):
        add(3 + half, both, parts[2] >> np.uint32(11) if half else parts[2] & np.uint32(2047))
    return np.concatenate(rows), np.concatenate(keys)


def _spaced(piece: Piece) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a piece with one space after each: bytes, starts, ends, and the index of each document's first word."""
    starts, ends, first = piece.words(NON_SPACE, lower=True)
    to = np.cumsum(ends - starts + 1) - 1 if len(starts) else np.zeros(0, np.int64)
    text = np.full(int(to[-1]) + 1 if len(to) else 0, 0x20, np.uint8)
    inside = np.ones(len(text), bool)
    inside[to] = False
    text[inside] = piece.data[NON_SPACE[piece.data]]
    return text.tobytes(), to - (ends - starts), to, first


def simhashes(column: pa.Array) -> np.ndarray:
    """The fingerprints of a string column (null: no words)."""
    out = []
    for piece in pieces(column):
        text, starts, ends, first = _spaced(piece)
        count = np.diff(first)
        grams = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
        owner = np.repeat(np.arange(len(piece)), grams)
        word = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + first[:-1][owner]
        last = word + np.minimum(count, SHINGLE)[owner] - 1
        ones = np.zeros((len(piece), 64), np.int64)
        digest = xxhash.xxh64_intdigest
        for lo in range(0, len(owner), _CHUNK):
            part = slice(lo, lo + _CHUNK)
            own = owner[part]
            hashes = np.fromiter((digest(text[s:e], SEED) for s, e in zip(starts[word[part]].tolist(), ends[last[part]].tolist(), strict=True)), np.uint64, len(own))
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            ones[own[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > grams[:, None], axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of every row of docs(doc_id, text): the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhashes(batch.column(1)).view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 20_000):
                prints = batch.column(0).slice(lo, 20_000).to_numpy()
                row, key = fuzzy_keys(prints.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row])], ["key", "print"])

    return nodes.select("print").mapInArrow(run, "key long, print long")


def _linked_parts(blocks: DataFrame) -> DataFrame:
    """Pairs (a, b) of components that a link joins, from blocks(key, i, j, side, print, part) sorted by key, i, j."""

    def compare(group: pa.Table) -> np.ndarray:
        side, prints, part = (group[c].to_numpy() for c in ("side", "print", "part"))
        left, right, found = np.flatnonzero(side == 0), np.flatnonzero(side == 1), []
        for lo in range(0, len(left), 256):
            rows = left[lo : lo + 256]
            near = np.bitwise_count((prints[rows][:, None] ^ prints[right][None, :]).view(np.uint64)) <= DISTANCE
            x, y = np.nonzero(near & (part[rows][:, None] != part[right][None, :]))
            if len(x):
                found.append(np.unique(np.stack([part[rows[x]], part[right[y]]], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def run(batches):
        rest = None
        for batch in batches:
            data = pa.Table.from_batches([batch])
            rest = (data if rest is None else pa.concat_tables([rest, data])).combine_chunks()
            marks = _marks(rest)
            for lo, hi in zip(marks[:-1], marks[1:], strict=True):
                yield from emit(rest.slice(int(lo), int(hi - lo)))
            rest = rest.slice(int(marks[-1])) if len(marks) else rest
        if rest is not None and len(rest):
            yield from emit(rest)

    def _marks(data: pa.Table) -> np.ndarray:
        k, i, j = (data[c].to_numpy() for c in ("key", "i", "j"))
        return np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(k) else np.zeros(0, np.int64)

    def emit(group: pa.Table):
        pairs = compare(group)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def _across(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Links between the components that members(key, print) of one key are in, with parts(node, component) from the stars."""
    labelled = materialise(members.select("key", "print").join(parts.withColumnRenamed("node", "print"), "print", "left").select("key", "print", F.coalesce("component", "print").alias("part")))
    of_key = labelled.groupBy("key", "part").count().groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.max("count").alias("top"), F.sum("count").alias("n"))
    split = materialise(of_key.where("top < n").select("key", "main", F.ceil((F.col("n") - F.col("top")) / BLOCK).alias("rows"), F.ceil(F.col("n") / BLOCK).alias("columns")))
    cells = join_hot(labelled, split, "key", "print")
    own = lambda count: F.pmod(F.xxhash64("print"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    left = cells.where("part <> main").select("key", own("rows").alias("i"), every("columns").alias("j"), F.lit(0).alias("side"), "print", "part")
    right = cells.select("key", every("rows").alias("i"), own("columns").alias("j"), F.lit(1).alias("side"), "print", "part")
    return _linked_parts(left.union(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    fingerprint is 16 hexadecimal digits; component_id is the smallest doc_id that links reach, the row's own included.  A null
    or empty text, or one of white space only, has fingerprint zero and links like any other.  A text of fewer than three
    words is one shingle.  Equal rows are in one component.  Rows that repeat a doc_id are one node with the links of
    all of them; rows without a doc_id link too, and get a null component only where no doc_id is reached.  An
    empty table gives no rows.  Other columns of docs are not read.
    """
    prints = materialise(fingerprints(docs))
    nodes = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    keyed = _keyed(nodes)
    groups = materialise(keyed.groupBy("key").agg(F.min("print").alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low"))
    members = materialise(join_hot(keyed, groups, "key", "print"))
    stars = members.where(f"print <> low AND bit_count(print ^ low) <= {DISTANCE}").select(F.col("low").alias("a"), F.col("print").alias("b"))
    several = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a < b").select("doc_id", "a")
    one_id = prints.join(several, "doc_id").select("a", F.col("print").alias("b"))
    links = materialise(stars.union(one_id).where("a <> b").distinct())
    parts = materialise(connected_components(links))
    found = connected_components(links.union(_across(members, parts)))
    placed = materialise(nodes.join(found.withColumnRenamed("node", "print"), "print", "left").select("print", F.coalesce("component", "print").alias("part"), "first"))
    named = placed.groupBy("part").agg(F.min("first").alias("component_id"))
    of_print = materialise(placed.join(named, "part").select("print", "component_id"))
    return join_hot(prints, of_print, "print", "doc_id").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
