"""As-of look-ups and first events per key, without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of one block: a window holds the rows of one key and block, and another one row per block of a key.
BLOCK = 1 << 16


def latest_before(rows: DataFrame, marks: DataFrame, keys: list[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """rows with `value`: of marks(keys, order, value) the one with the largest order below the row's, or null.

    order is a whole number and marks has at most one row per key and order (of several the largest value counts).  A key that holds very many rows is
    cut into blocks of its order, so no task sorts all of it; keys compare null-safe.  rows must not have a column `value`.
    """
    own = F.floor(F.col(order) / block)
    side = [c for c in rows.columns if c not in (*keys, order)]
    a = rows.select(*keys, order, F.struct(*(side or [order])).alias("_row"), F.lit(None).cast(marks.schema[value].dataType).alias("_mark"))
    b = marks.groupBy(*keys, order).agg(F.max(value).alias("_mark")).select(*keys, order, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), "_mark")
    both = a.union(b).withColumn("_block", own)
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("_near", F.max(F.when(F.col("_mark").isNotNull(), F.struct(order, "_mark"))).over(inside)).where("_row IS NOT NULL")
    ends = b.withColumn("_block", own).groupBy(*keys, "_block").agg(F.max_by("_mark", order).alias("_last"))
    used = both.select(*keys, "_block").distinct().withColumn("_last", F.lit(None).cast(marks.schema[value].dataType))
    per_block = ends.union(used.select(ends.columns)).groupBy(*keys, "_block").agg(F.max("_last").alias("_last"))
    carried = per_block.withColumn("_far", F.last("_last", True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).where("_far IS NOT NULL")
    far = carried.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), "_far")
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = near.join(far, same, "left")
    shown = F.coalesce(F.col("_near._mark"), F.col("_far")).alias(value)
    return found.select(*keys, order, *(F.col(f"_row.{c}").alias(c) for c in side), shown).select(*rows.columns, value)


def first_of(events: DataFrame, keys: list[str], order: str, which: Column, name: str) -> DataFrame:
    """(keys, name): the smallest order of the events of a key for which `which` holds; a partial aggregate, however many events a key has."""
    return events.where(which).groupBy(*keys).agg(F.min(order).alias(name))
