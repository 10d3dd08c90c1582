"""Session helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set, as in local tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="lakewright-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: computed once, lineage cut, survives lost executors."""
    path = f"{shared(df.sparkSession)}/lakewright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Entries (rows of a few numbers) of a table that may be broadcast once they are counted.
BROADCAST_ENTRIES = 500_000


def small(df: DataFrame, entries: str = "1") -> DataFrame:
    """df, to be broadcast if its entries (SQL, by row) sum up to BROADCAST_ENTRIES at most; else joins shuffle it.

    df must be a written table: it is read once to be counted.
    """
    total = df.agg(F.sum(F.expr(entries).cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_ENTRIES else df


#: Copies of a table that is too large to be broadcast, against keys that very many rows share.
SALTS = 32


def join_hot(rows: DataFrame, table: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """rows joined to a written table of one row per key, where one key may hold a third of rows: no task gets more than a SALTS-th of a key.

    spread is a column of rows that differs within a key.
    """
    ready = small(table)
    if ready is not table:
        return rows.join(ready, key, how)
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"], how).drop("_salt")


@contextlib.contextmanager
def small_batches(spark: SparkSession, limit: int = 4 << 20) -> Iterator[None]:
    """Jobs inside send Python about `limit` bytes in an Arrow batch at most: a batch of texts is held by Spark and by the worker, twice while it is read."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps; every step is a shuffle by node, and
    the edge list is written after each round.  Self-edges and repeats are allowed.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        closer = large.join(small_low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = materialise(closer.where("u <> v").distinct())
        same = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        if new.agg(F.count("*"), same).first() == edges.agg(F.count("*"), same).first():
            break
        edges = new
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
