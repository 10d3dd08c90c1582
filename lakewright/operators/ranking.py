"""Positions in a total order over a whole table: no task sees more than one range of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.plans.dialect import LazyOracle, frame
from lakewright.plans.registry import query
from lakewright.plans.written import written


def positions(df: DataFrame, order: list[Column], name: str = "place", ranges: int | None = None) -> DataFrame:
    """df with the position of each row, from 1, by `order`; the order should be total, rows that tie are numbered as they come.

    Rows are dealt by ranges of the order (as many as the session has shuffle partitions, if not said) and written, each range is numbered on its own, and the counts of the ranges before it (one row a range) are
    added.  Nulls stand where the order puts them; an empty table stays empty.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")


@query("lead_rank", LazyOracle("SELECT url, round(rank_score, 6) AS score, row_number() OVER (ORDER BY rank_score DESC, url) AS place FROM lead_scores"))
def lead_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leads by score, then link."""
    scores = frame(spark, sf_dir, "lead_scores").select("url", "rank_score")
    return positions(scores, [F.desc("rank_score"), F.asc("url")]).select("url", F.round("rank_score", 6).alias("score"), "place")


@query("export_order", LazyOracle("SELECT row_number() OVER (ORDER BY entity_id) AS position, entity_id, entity_class FROM entities WHERE entity_class <> 'order'"))
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities in the order of an export."""
    entities = frame(spark, sf_dir, "entities").where("entity_class <> 'order'").select("entity_id", "entity_class")
    return positions(entities, [F.asc("entity_id")], "position")
