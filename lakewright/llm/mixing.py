"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Every document of a source expects rate = target / source size copies.  The documents of a
source stand in one order; each takes the integers that the running sum of expected copies,
plus one random offset per source, passes over it: floor or ceil of the rate.  The order goes by
size first (fine size classes, then blocks by hash, then size), so the words taken stay near the target and a source of
many documents uses the first offset it draws.  A small source whose few long documents would take it further than NEAR from its target draws again,
up to OFFSETS times, and keeps the first offset that comes so near, or the nearest.

The running sum is exact without one task per source: a row's rank within its
(source, class, block) cell plus the number of rows of earlier cells, times the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import materialise

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Size classes per doubling of the size; blocks per class at least, and rows per block beyond: cells that one task sorts.
CLASSES, BLOCKS, CELL = 32, 8, 1_000_000
#: Offsets that a source may draw, and how near to its target it must come with one.
OFFSETS, NEAR = 16, 0.01


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, rows) of sized(source, size).

    Sources by code point, null last, take the weights in turn.  A target is level * weight, but at most
    max_repeats times the source's size; the level is the one at which the targets sum up to share of all
    sizes.  Only sources, one row each, meet in one task.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    everything = Window.partitionBy()
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted, weight = F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("weight").over(everything)
    level = (wanted - (F.sum("cap").over(fills) - F.col("cap"))) / (weight - (F.sum("weight").over(fills) - F.col("weight")))
    full = weighed.withColumn("full", F.col("cap") < level * F.col("weight")).withColumn("wanted", wanted).withColumn("all", weight)
    held = lambda c: F.sum(F.when(F.col("full"), F.col(c)).otherwise(0.0)).over(everything)
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    final = F.when(F.col("full"), F.col("cap")).otherwise((F.col("wanted") - held("cap")) / open_ * F.col("weight"))
    return full.select("source", "source_size", final.alias("target"), "rows")


def _placed(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """sized(doc_id, source, size, tie, ...) with _name, source_size, target, _rate and _last, the row's place among its source's rows."""
    level = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * CLASSES)).otherwise(-1).cast("int")
    # of all rows one class of one source may hold most: blocks grow with the table
    blocks = max(BLOCKS, -(-sum(r.rows for r in targets.groupBy().agg(F.sum("rows").alias("rows")).collect() if r.rows) // CELL))
    block = F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.lit(blocks)).cast("int")
    rows = sized.withColumns({"_name": _name(), "_class": level, "_block": block})
    cell = ["_name", "_class", "_block"]
    counts = rows.groupBy(*cell).agg(F.count("*").alias("_rows"))
    order = Window.partitionBy("_name").orderBy("_class", "_block")
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    wanted = targets.select(_name().alias("_name"), *(c for c in targets.columns if c not in ("source", "rows")), rate.alias("_rate"))
    cells = counts.withColumn("_before", F.sum("_rows").over(order) - F.col("_rows")).drop("_rows").join(wanted, "_name")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc_id", "tie")))
    return ranked.join(cells, cell).withColumn("_last", F.col("_before") + F.col("_rank")).drop("_class", "_block", "_before", "_rank")


def _name() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))  # a key that joins nulls too


def _copies(offset: Column, max_repeats: int) -> Column:
    upto = lambda k: F.floor(k * F.col("_rate") + offset)
    return F.least(upto(F.col("_last")) - upto(F.col("_last") - 1), F.lit(max_repeats)).cast("int")


def with_offsets(sized: DataFrame, targets: DataFrame, seed: int = 0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """targets with `offset`: the first of OFFSETS random offsets per source whose words come within NEAR of the target, else the nearest."""
    tried = [F.pmod(F.xxhash64("_name", F.lit(seed), F.lit(j)), F.lit(1 << 32)) / F.lit(float(1 << 32)) for j in range(OFFSETS)]
    taken = [F.sum(F.col("size") * _copies(u, max_repeats)) for u in tried]
    sums = _placed(sized, targets, seed).groupBy("_name").agg(F.first("target").alias("_t"), *(x.alias(f"_w{j}") for j, x in enumerate(taken)))
    far = lambda j: F.greatest(F.abs(F.col(f"_w{j}") - F.col("_t")), NEAR * F.col("_t"))
    best = F.array_min(F.array(*(F.struct(far(j).alias("far"), F.lit(j).alias("draw"), u.alias("offset")) for j, u in enumerate(tried))))["offset"]
    chosen = sums.select("_name", best.alias("offset"))
    return targets.withColumn("_name", _name()).join(chosen, "_name").drop("_name")


def with_copies(sized: DataFrame, targets: DataFrame, seed: int = 0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sized(doc_id, source, size, tie, ...) with source_size, target and copies; tie orders rows of equal doc_id and size."""
    return _placed(sized, targets, seed).withColumn("copies", _copies(F.col("offset"), max_repeats)).drop("_name", "_rate", "_last", "offset")


def _plan(docs: DataFrame, weights: tuple[float, ...], share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    sized = materialise(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    targets = materialise(source_targets(sized, weights, share))
    return sized, materialise(with_offsets(sized, targets, seed))


def mixed_sizes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, seed: int = 0) -> DataFrame:
    """Per row of docs(doc_id, source, text): doc_id, size, source_size, target, taken (size * copies).

    Sizes are words; null and empty texts have none and take none.  Null sources are one source, the last.
    Repeated rows are documents of their own; every row is judged once.  Runs agree with one another: the random
    offsets and blocks are hashes of the seed.
    """
    out = with_copies(*_plan(docs, weights, share, seed), seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, seed: int = 0) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs."""
    whole = F.struct(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns))).alias("_row")
    _, targets = _plan(docs, weights, share, seed)
    sized = docs.select(whole, "doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    out = with_copies(sized, targets, seed).where("copies > 0")
    rows = out.select(F.explode(F.array_repeat("_row", F.col("copies"))).alias("_row"))
    return rows.select(*(F.col(f"_row._c{i}").alias(c) for i, c in enumerate(docs.columns)))
