"""Sink queries: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.plans.dialect import LazyOracle, frame
from lakewright.plans.registry import query
from lakewright.plans.written import shared_folder
from lakewright.sources.lake import export_run, latest_run, put_bronze, scan_bronze


@query("gold_export", LazyOracle("SELECT entity_class, count(*) AS n, 'run-0' AS run_id FROM entities GROUP BY entity_class"))
def gold_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports the entities of a run, moves the pointer and reads the run back through it."""
    path = f"{shared_folder(spark)}/exports/{uuid.uuid4().hex}"
    export_run({"entities": frame(spark, sf_dir, "entities")}, path, "run-0")
    run = latest_run(spark, path)
    back = spark.read.schema("entity_id string, entity_class string").json(f"{path}/{run}/entities")
    return back.groupBy("entity_class").agg(F.count("*").alias("n")).withColumn("run_id", F.lit(run))


@query("scan_bronze", "SELECT 'sha256:' || sha256(name) AS bronze_key, TRUE AS intact FROM (SELECT DISTINCT r_name AS name FROM region)")
def scan_bronze_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts each region's name into the store under its digest, puts them all again, and scans the store."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    names = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").cast("binary").alias("content"))
    for _ in range(2):
        put_bronze(names, root)
    return scan_bronze(spark, root).select("bronze_key", "intact")
