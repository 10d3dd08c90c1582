"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles as 64-bit hashes.  A set is XOR-hashed
into parity sketches: every element flips one bit, so the Hamming distance of two
sketches never exceeds the sets' symmetric difference.  Two sketches are used:

* a wide one per size band, held sparsely: the band of a set of size n is c = floor(log2 n),
  its sketch has k(c) words, and a word is folded to the XOR of the codes of its bits.
  Sets that link differ in at most D = floor((n + m) / 9) elements (at 0.8), so at most D
  of the k words differ: the sets agree on k - D words at least.  Words are keys; by the
  prefix principle each set emits only its first D + 1 in one order that all sets share
  (words of more elements first), and two linking sets still share a key;
* a dense one of 1,024 bits, whose Hamming distance prunes pairs before they are verified.

No pair is lost.  Pairs are not expanded inside groups of copies: the members of a key
are first verified against the smallest one; only members of a key that are still in
different components are compared with one another, in blocks of bounded size, by sketch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import connected_components, join_hot, materialise, small
from lakewright.llm.text import NON_SPACE, gram_hashes, mix, pieces
from lakewright.llm.worker import releasing

SKETCH_WORDS = 16
#: Members of a group in one block, and pairs of one first document in one part.
BLOCK, PART = 1024, 4096
#: Bytes of sets in one batch; a longer set is a batch of its own.
BATCH_BYTES = 64 << 20


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text: whole word sequence if it has fewer than n words."""
    for piece in pieces(column):
        words, first = piece.word_hashes(NON_SPACE, lower=True)
        grams = gram_hashes(words, n)
        for i in range(len(piece)):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield gram_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def _sketch(items: np.ndarray) -> bytes:
    """Parity of the elements in each of 1,024 bits."""
    bits = np.bincount((items >> np.uint64(20)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _widths(c: int, limit: tuple[int, int]) -> int:
    """Words of the wide sketch of size band c: more than any two linking sets of it can differ in."""
    num, den = limit
    small = 2 ** (c + 1) - 1
    most = (den - num) * (small + small * den // num) // (den + num)
    return 2 * most + 3 if c < 6 else 3 * (most + 1) // 2 + 2


def _keys(items: np.ndarray, limit: tuple[int, int]) -> np.ndarray:
    """The keys that a set shares with every set it may link to."""
    num, den = limit  # a link has den * intersection >= num * union
    n = len(items)
    own, out = n.bit_length() - 1, []
    bands = [(own, (den - num) * (n + n * den // num) // (den + num))]
    below = 2**own - 1  # the largest size of the band below
    if below and den * below >= num * n:
        bands.append((own - 1, (den - num) * (n + below) // (den + num)))
    for c, differ in bands:
        k = _widths(c, limit)
        word = (items % np.uint64(k)).astype(np.int64)
        order = np.argsort(word, kind="stable")
        at = word[order]
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        folded = np.zeros(k, np.uint64)
        folded[at[begin]] = np.bitwise_xor.reduceat(mix(items[order] + np.uint64(c)), begin)
        key = mix(folded + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c << 40))
        most = np.lexsort((key, -np.bincount(word, minlength=k)))
        out.append(key[most[: differ + 1]])
    return np.concatenate(out).view(np.int64)


def _identity(items: np.ndarray) -> bytes:
    a = np.add.reduce(items, dtype=np.uint64)
    b = np.add.reduce(mix(items), dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, identity, sketch) of every row; identity is a 128-bit hash of the set."""

    @releasing
    def run(batches):
        for batch in batches:
            sizes, ids, sketches = [], [], []
            for items in _sets(batch.column(1), n):
                sizes.append(len(items))
                ids.append(_identity(items))
                sketches.append(_sketch(items))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "size", "identity", "sketch"])

    return docs.mapInArrow(run, "doc_id long, size long, identity binary, sketch binary")


def _key_rows(docs: DataFrame, n: int, limit: tuple[int, int]) -> DataFrame:
    """(key, doc_id); a set that the same batch has had already is left out, as copies are linked by identity."""

    @releasing
    def run(batches):
        for batch in batches:
            ids, seen = batch.column(0).to_numpy(zero_copy_only=False), set()
            keys, owners, rows = [], [], 0
            for doc_id, items in zip(ids, _sets(batch.column(1), n), strict=True):
                if not len(items) or (identity := _identity(items)) in seen:
                    continue
                seen.add(identity)
                got = _keys(items, limit)
                keys.append(got)
                owners.append(np.full(len(got), doc_id, np.int64))
                rows += len(got)
                if rows > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "doc_id"])
                    keys, owners, rows = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "doc_id"])

    return docs.mapInArrow(run, "key long, doc_id long")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, limit: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose whole sets link; pairs is a written table.

    Every set is sent straight to its pairs: b's to (a, part), a's to each of its parts, which hold at most PART pairs.
    """
    num, den = limit
    # parts by hash, as many as PART asks for: counted by partial aggregates, so no task holds all pairs of a much copied document
    many = small(materialise(pairs.groupBy("a").count().where(F.col("count") > PART).select("a", F.ceil(F.col("count") / PART).alias("parts"))))
    parted = pairs.join(many, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    send = parted.select("a", "part", F.col("b").alias("doc_id")).union(parted.select("a", "part", F.col("a").alias("doc_id")).distinct())
    send = small(materialise(send.groupBy("doc_id").agg(F.collect_list(F.struct("a", "part")).alias("to"))), "size(to)")

    @releasing
    def sets(batches):
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                rows, size = [], 0
                for doc_id, items, to in zip(part.column(0).to_pylist(), _sets(part.column(1), n), part.column(2).to_pylist(), strict=True):
                    data = items.tobytes()
                    for t in to:
                        rows.append((t["a"], t["part"], t["a"] != doc_id, doc_id, data))
                        size += len(data)
                        if size > BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    @releasing
    def check(batches):
        at, first = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, part, member, ids, items = (batch.column(i) for i in range(5))
            found_a, found_b = [], []
            for k, (x, y, later, doc_id) in enumerate(zip(a.to_pylist(), part.to_pylist(), member.to_pylist(), ids.to_pylist(), strict=True)):
                own = np.frombuffer(items[k].as_buffer(), np.uint64)
                if not later:
                    at, first = (x, y), own.copy()
                elif at == (x, y) and _link(first, own, num, den):
                    found_a.append(x)
                    found_b.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    sent = docs.join(send, "doc_id").select("doc_id", "text", "to").mapInArrow(sets, "a long, part int, member boolean, doc_id long, items binary")
    return sent.repartition("a", "part").sortWithinPartitions("a", "part", "member").mapInArrow(check, "a long, b long").distinct()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["a", "part", "member", "doc_id", "items"])


def _link(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x)) if len(y) else 0
    return den * both >= num * (len(x) + len(y) - both)


def _across(members: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of one (key, i, j) in different components that size and sketch allow.

    members: key, i, j, side, doc_id, component, size, sketch, sorted by key, i, j.  A group holds at most
    two blocks of BLOCK members.
    """
    num, den = limit

    def pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side = group["side"].to_numpy()
        ids, parts, sizes = (group[c].to_numpy() for c in ("doc_id", "component", "size"))
        bits = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        found_a, found_b = [], []
        for lo in range(0, len(left), 128):
            rows = left[lo : lo + 128]
            may = parts[rows][:, None] != parts[right][None, :]
            may &= ids[rows][:, None] != ids[right][None, :]
            n, m = sizes[rows][:, None], sizes[right][None, :]
            may &= den * np.minimum(n, m) >= num * np.maximum(n, m)
            x, y = np.nonzero(may)
            for c in range(0, len(x), 1 << 16):
                i, j = rows[x[c : c + (1 << 16)]], right[y[c : c + (1 << 16)]]
                far = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1)
                near = (den + num) * far <= (den - num) * (sizes[i] + sizes[j])
                found_a.append(np.minimum(ids[i][near], ids[j][near]))
                found_b.append(np.maximum(ids[i][near], ids[j][near]))
        return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    @releasing
    def run(batches):
        rest = None
        for batch in batches:
            data = pa.Table.from_batches([batch])
            rest = data if rest is None else pa.concat_tables([rest, data])
            rest, done = (rest, None) if not len(rest) else _split(rest)
            if done is not None:
                yield from emit(done)
        if rest is not None and len(rest):
            yield from emit(rest)

    def _split(data: pa.Table) -> tuple[pa.Table, pa.Table | None]:
        marks = _marks(data)
        last = int(marks[-1])
        return data.slice(last), (data.slice(0, last) if last else None)

    def _marks(data: pa.Table) -> np.ndarray:
        k, i, j = (data[c].to_numpy() for c in ("key", "i", "j"))
        return np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])

    def emit(data: pa.Table):
        data = data.combine_chunks()
        marks = np.r_[_marks(data), len(data)]
        for lo, hi in zip(marks[:-1], marks[1:], strict=True):
            a, b = pairs(data.slice(int(lo), int(hi - lo)))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return members.mapInArrow(run, "a long, b long").distinct()


def link_components(docs: DataFrame, n: int = 5, limit: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text).

    component_id is the smallest doc_id that links reach; documents link when
    limit[1] * intersection >= limit[0] * union.  A null or empty text, or one of white space only, has no
    shingles and stays alone.  Rows that repeat a doc_id are one node with the links of all of
    them; a row without a doc_id gets a null component.  Other columns of docs are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    if not known.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _unique_components(docs, n, limit)
    # texts are nodes of their own first, then the texts of one doc_id join
    node = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = materialise(_unique_components(docs.select(node.alias("doc_id"), "text"), n, limit).withColumnsRenamed({"doc_id": "node", "component_id": "part"}))
    owners = materialise(known.select(node.alias("node"), "doc_id").distinct())
    parts = materialise(found.select("node", "part").distinct().join(owners, "node").select("doc_id", "part").distinct())
    low = parts.groupBy("doc_id").agg(F.min("part").alias("low"))
    joined = materialise(connected_components(parts.join(low, "doc_id").where("part <> low").select(F.col("part").alias("a"), F.col("low").alias("b"))))
    final = parts.join(joined.withColumnRenamed("node", "part"), "part", "left").select("doc_id", F.coalesce("component", "part").alias("part"))
    ids = final.join(final.groupBy("part").agg(F.min("doc_id").alias("component_id")), "part").select("doc_id", "component_id").distinct()
    named = found.select("node", "n_shingles").join(owners, "node", "left").select("doc_id", "n_shingles")
    return named.join(ids, "doc_id", "left").select("doc_id", "n_shingles", "component_id")


def _unique_components(docs: DataFrame, n: int, limit: tuple[int, int]) -> DataFrame:
    """link_components of docs whose equal doc_ids have equal texts."""
    known = docs.where("doc_id is not null")
    sets = materialise(document_sets(docs, n))
    same = sets.where("size > 0 and doc_id is not null")
    # the smallest copy by partial aggregates; of a set in very many documents no task sees more than one row per partition, and the way back is salted
    firsts = materialise(same.groupBy("identity").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("identity", "first"))
    copies = join_hot(same.select("doc_id", "identity"), firsts, "identity", "doc_id").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()

    by_key = Window.partitionBy("key")
    facts = materialise(same.groupBy("doc_id").agg(F.min_by(F.struct("size", "sketch"), "identity").alias("f")))
    # keys with the same members are one group, named by a hash of them
    member = F.xxhash64("doc_id")
    spread = _key_rows(known, n, limit).withColumn("low", F.min("doc_id").over(by_key)).withColumn("high", F.max("doc_id").over(by_key)).where("low < high")
    marks = (F.sum(F.shiftright(member, 24)).over(by_key), F.sum(member.bitwiseAND(2**32 - 1)).over(by_key), F.count("*").over(by_key))
    groups = materialise(spread.withColumn("key", F.xxhash64(*marks, "low", "high")).select("key", "doc_id", "low").distinct())
    stars = groups.where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = materialise(_verified(materialise(_near(stars, facts, limit)), known, n, limit).union(copies))

    parts = materialise(connected_components(links))
    labelled = groups.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    apart = labelled.withColumn("c0", F.min("component").over(by_key)).withColumn("c1", F.max("component").over(by_key)).where("c0 < c1")
    numbered = apart.withColumn("members", F.count("*").over(by_key)).withColumn("b", F.floor((F.row_number().over(by_key.orderBy("doc_id")) - 1) / BLOCK))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("members") - 1) / BLOCK))
    split = numbered.select("key", "doc_id", "component", "b", F.explode(blocks).alias("o")).select("key", "doc_id", "component", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side"))
    split = split.join(facts.select("doc_id", "f.size", "f.sketch"), "doc_id").select("key", "i", "j", "side", "doc_id", "component", "size", "sketch")
    split = split.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = _verified(materialise(_across(split, limit)), known, n, limit)
    found = connected_components(links.union(more)).withColumnRenamed("node", "doc_id")
    return sets.select("doc_id", F.col("size").alias("n_shingles")).join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _near(pairs: DataFrame, facts: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """Drops pairs whose sizes or sketches rule a link out."""
    num, den = limit
    words = F.transform(F.sequence(F.lit(0), F.lit(SKETCH_WORDS - 1)), lambda i: F.conv(F.hex(F.substring(F.col("sketch"), i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    ready = facts.select("doc_id", F.col("f.size").alias("size"), F.col("f.sketch").alias("sketch")).select("doc_id", "size", words.alias("words"))
    x, y = (ready.select(F.col("doc_id").alias(s), F.col("size").alias(f"n{s}"), F.col("words").alias(f"w{s}")) for s in "ab")
    far = F.aggregate(F.zip_with("wa", "wb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    near = pairs.join(x, "a").join(y, "b").where((den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & ((den + num) * far <= (den - num) * (F.col("na") + F.col("nb"))))
    return near.select("a", "b")


def near_duplicates_removed(docs: DataFrame, n: int = 5) -> DataFrame:
    """The rows of docs without those that link to an earlier one: of each component the smallest doc_id stays.

    Of rows that repeat a doc_id all stay or go together; rows without a doc_id stay.
    """
    parts = link_components(docs, n)
    gone = parts.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
