"""Token ids in a binary file format: bit planes, zstandard, chunk index.

Format.  A block holds BLOCK ids (the last one of a chunk fewer) as little-endian unsigned
32-bit integers: they are written as 8 * width bit planes (plane b has bit b of every id, eight
ids a byte), where width is the number of bytes that the block's largest id needs; every plane is
one zstandard frame.  Block: width, count, then for each plane its length and its frame.  A chunk is
the magic "LWTB", a version, the number of blocks and the blocks; it holds whole documents, CHUNK ids
or a little more.  A shard is one task's range of documents in doc_id order.  Chunks are rows of
a Parquet dataset (shard, chunk, first id within the shard, ids, payload, and the doc_id and length of
each document), whose writer commits whole tasks and works on any store; all columns but the payload are the
chunk index: they find a document's ids without decoding other chunks.

Encoding.  A byte-level BPE works inside the pieces of its split pattern, and a white-space
character that follows a non-space one always begins a piece.  So a text's ids are those of
its chunks (white space, then non-space), one after another.  A task encodes each distinct
chunk once with the tokenizers library and looks the others up by hash.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import materialise, shared, small, small_batches
from lakewright.llm.text import hash_ranges, pieces
from lakewright.llm.worker import kept, releasing

CHUNK, BLOCK = 1 << 16, 1 << 14
MAGIC = b"LWTB\x01"
#: Distinct chunks a worker keeps, from task to task: the first it meets, unless most of the chunks it meets later are others.
CACHE = 1_500_000


class CachedEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, each distinct chunk once."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.marks = {c: self._whole(c) for c in ".,;:!?"}
        self.alphabet = _byte_alphabet()
        self.end = end_id
        self.clear()

    def clear(self) -> None:
        self.tables = [_Table.empty()]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _chunk(self, text: str) -> list[int]:
        """One chunk's ids.  Letters alone, with a space before or a mark after, are one piece (or two) of the split pattern."""
        mark = self.marks.get(text[-1])
        body = text[:-1] if mark else text
        try:
            plain = (body[1:] if body[:1] == " " else body).encode("latin-1").decode("latin-1").isalpha()
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return self._whole(text)
        ids = [t.id for t in self.model.tokenize(body.encode().decode("latin-1").translate(self.alphabet))]
        return ids + mark if mark else ids

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, merge: bool = True) -> None:
        """Adds chunks (ascending hashes); small tables are merged into larger ones, so that there are few."""
        raw = data.tobytes()
        found = [self._chunk(raw[a:b].decode("utf-8", "replace")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        lengths = np.array([len(x) for x in found], np.int64)
        table = _Table(hashes, np.cumsum(lengths) - lengths, lengths, np.array([i for x in found for i in x], np.uint32))
        while merge and self.tables and len(self.tables[-1].hashes) < 4 * len(table.hashes):
            table = _Table.merged(self.tables.pop(), table)
        self.tables.append(table)

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some consecutive texts, each with the end id; ids of each text)."""
        for piece in pieces(column):
            data, starts, ends = piece.data, *_chunks(piece.data, piece.offsets)
            unique, at, back = np.unique(hash_ranges(data, starts, ends), return_index=True, return_inverse=True)
            fresh = np.flatnonzero(self._find(unique)[0] < 0)
            full = sum(len(t.hashes) for t in self.tables) + len(fresh) > CACHE
            if full and 2 * len(fresh) > len(unique):  # the texts have changed
                self.clear()
                fresh, full = np.arange(len(unique)), False
            kept = list(self.tables)
            if len(fresh):
                self._learn(data, starts[at[fresh]], ends[at[fresh]], unique[fresh], merge=not full)
            where, entry = self._find(unique)
            size, begin, parts, base = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64), [], 0
            for k, table in enumerate(self.tables):
                mine = where == k
                size[mine] = table.lengths[entry[mine]]
                got = np.repeat(table.begin[entry[mine]] - (np.cumsum(size[mine]) - size[mine]), size[mine]) + np.arange(int(size[mine].sum()))
                begin[mine] = base + np.cumsum(size[mine]) - size[mine]
                parts.append(table.ids[got])
                base += len(got)
            if full:  # what was learnt serves this piece only
                self.tables = kept
            ids = np.concatenate(parts)
            lengths = size[back]
            # every document's chunks, then one end id
            border = np.searchsorted(starts, piece.offsets)
            total = np.r_[0, np.cumsum(lengths)]
            counts = total[border[1:]] - total[border[:-1]] + 1
            out = np.full(int(counts.sum()), self.end, np.uint32)
            source = np.repeat(begin[back] - total[:-1], lengths) + np.arange(int(total[-1]))
            target = np.arange(int(total[-1])) + np.repeat(np.arange(len(counts)), counts - 1)
            out[target] = ids[source]
            yield out, counts

    def _find(self, unique: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every hash the table that has it (-1: none) and its place there."""
        where, entry = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
        for k, table in enumerate(self.tables):
            if len(table.hashes):
                at = np.searchsorted(table.hashes, unique)
                at[at == len(table.hashes)] = 0
                hit = table.hashes[at] == unique
                where[hit], entry[hit] = k, at[hit]
        return where, entry


class _Table:
    """Chunks by ascending hash: their ids are ids[begin : begin + length]."""

    def __init__(self, hashes: np.ndarray, begin: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        self.hashes, self.begin, self.lengths, self.ids = hashes, begin.astype(np.uint32), lengths.astype(np.uint32), ids

    @staticmethod
    def empty() -> _Table:
        return _Table(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0, np.uint32))

    @staticmethod
    def merged(a: _Table, b: _Table) -> _Table:
        hashes = np.r_[a.hashes, b.hashes]
        order = np.argsort(hashes, kind="stable")
        begin = np.r_[a.begin, b.begin.astype(np.int64) + len(a.ids)]
        return _Table(hashes[order], begin[order], np.r_[a.lengths, b.lengths][order], np.r_[a.ids, b.ids])


def encoder_for(path: str, end_id: int) -> CachedEncoder:
    """This worker's encoder: its table of chunks serves all tasks that the worker runs."""
    return kept(("encoder", path, end_id), lambda: CachedEncoder(path, end_id))


def _byte_alphabet() -> dict[int, int]:
    """Byte -> the printable character that byte-level BPE vocabularies write for it: itself if printable, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 0x100 + k for k, b in enumerate(hidden)}


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts before a space or line feed that follows a character that surely is no white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = (data == 0x20) | (data == 0x0A)
    solid = (data > 0x20) & (data < 0x7F)  # ASCII
    letter = np.zeros(len(data), bool)  # the second byte of U+00C0..U+07FF
    letter[1:] = (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    cut[1:] &= (solid | letter)[:-1]
    cut[0] = True
    borders = offsets[:-1]
    cut[borders[np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.r_[starts[1:], len(data)]


def pack(ids: np.ndarray, level: int = 3) -> bytes:
    """One chunk's payload."""
    ids = np.ascontiguousarray(ids, "<u4")
    parts = [MAGIC, struct.pack("<I", -(-len(ids) // BLOCK))]
    squeeze = zstandard.ZstdCompressor(level=level)
    for lo in range(0, len(ids), BLOCK):
        block = ids[lo : lo + BLOCK]
        width = max(1, (int(block.max()).bit_length() + 7) // 8)
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 4)[:, :width], axis=1, bitorder="little")
        planes = [squeeze.compress(np.packbits(bits[:, b], bitorder="little").tobytes()) for b in range(8 * width)]
        parts += [struct.pack("<BI", width, len(block)), *(struct.pack("<I", len(p)) + p for p in planes)]
    return b"".join(parts)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of one chunk."""
    if payload[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token chunk")
    (blocks,) = struct.unpack_from("<I", payload, len(MAGIC))
    at, expand, out = len(MAGIC) + 4, zstandard.ZstdDecompressor(), [np.zeros(0, "<u4")]
    for _ in range(blocks):
        width, count = struct.unpack_from("<BI", payload, at)
        at += 5
        bits = np.zeros((count, 32), np.uint8)
        for b in range(8 * width):
            (size,) = struct.unpack_from("<I", payload, at)
            plane = np.frombuffer(expand.decompress(payload[at + 4 : at + 4 + size]), np.uint8)
            bits[:, b] = np.unpackbits(plane, count=count, bitorder="little")
            at += 4 + size
        out.append(np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1))
    return np.concatenate(out)


_ROW = "shard int, chunk int, first long, n_ids long, payload binary, doc_ids array<long>, doc_lengths array<long>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, chunk: int = CHUNK) -> None:
    """Writes the ids of docs(doc_id, text) in ascending doc_id order (null first, ties by text) under path.

    Null texts are empty: they have the end id alone.  Rows that repeat a doc_id are written one after another.
    An empty table writes no chunk.
    """

    @releasing
    def run(batches):
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), encoder_for(tokenizer, end_id)
        parts, names, lengths, waiting, number, first = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            nonlocal parts, names, lengths, waiting, number, first
            columns = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([waiting], pa.int64()), pa.array([pack(np.concatenate(parts))], pa.binary()), pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays(columns, ["shard", "chunk", "first", "n_ids", "payload", "doc_ids", "doc_lengths"])
            parts, names, lengths, waiting, number, first = [], [], [], 0, number + 1, first + waiting
            return out

        for batch in batches:
            ids_of, at = batch.column(0).to_pylist(), 0
            for ids, counts in encoder.encode(batch.column(1)):
                ends = np.cumsum(counts)
                begin = done = 0
                for k in range(len(counts)):
                    if waiting + ends[k] - done >= chunk or k == len(counts) - 1:
                        parts.append(ids[done : ends[k]])
                        names += ids_of[at + begin : at + k + 1]
                        lengths += counts[begin : k + 1].tolist()
                        waiting += int(ends[k]) - done
                        begin, done = k + 1, int(ends[k])
                        if waiting >= chunk:
                            yield row()
                at += len(counts)
        if names:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(run, _ROW)
    with small_batches(docs.sparkSession):
        rows.write.mode("overwrite").parquet(path)


def shard_starts(rows: DataFrame) -> DataFrame:
    """(shard, before): the ids of all earlier shards; one row per shard meets in one task."""
    shards = rows.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    return shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))


def read_tokens(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all before it), n_tokens, ids_crc32 (its ids as little-endian 32-bit)."""
    rows = spark.read.schema(_ROW).parquet(path)
    placed = rows.join(small(materialise(shard_starts(rows))), "shard")

    @releasing
    def run(batches):
        for batch in batches:
            for k in range(len(batch)):  # one chunk at a time as Python objects
                row = batch.slice(k, 1).to_pylist()[0]
                data, at = unpack(row["payload"]).tobytes(), 0
                done = []
                for name, count in zip(row["doc_ids"], row["doc_lengths"], strict=True):
                    done.append((name, row["at"] + at, count, zlib.crc32(memoryview(data)[4 * at : 4 * (at + count)])))
                    at += count
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("payload", (F.col("first") + F.col("before")).alias("at"), "doc_ids", "doc_lengths").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes docs under path (a new folder in the shared one by default) and reads the files back."""
    spark = docs.sparkSession
    path = path or f"{shared(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path)
