"""Bronze: the content-addressed store, its sidecars, and tolerant JSON-lines scans."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.plans.written import written

KEY = re.compile(r"(sha256:[0-9a-f]{64}|(gold|runs)/[A-Za-z0-9_./-]+)")


def valid_key(key: str) -> bool:
    """Whether a key is a content address or a path below gold/ or runs/ without . and .. segments."""
    return bool(KEY.fullmatch(key)) and not any(p in ("", ".", "..") for p in key.split("/"))


def object_path(root: str, key: str) -> str:
    """The path of a key below root: content addresses live under bronze/sha256."""
    if not valid_key(key):
        raise ValueError(f"not a key: {key!r}")
    return f"{root}/bronze/sha256/{key[7:]}" if key.startswith("sha256:") else f"{root}/{key}"


def put_bronze(payloads: DataFrame, root: str) -> DataFrame:
    """Stores each distinct payload of payloads(content) under its digest, from the tasks; (bronze_key, length, put): put says that it was not there before.

    An object appears whole or not at all and is never overwritten, so a repeated task changes nothing (and may report put = false for what its
    first attempt stored).  Null payloads are not stored.  root is a path or a URI of a file system that all executors reach.
    """
    distinct = payloads.where("content is not null").select(F.sha2("content", 256).alias("name"), "content").dropDuplicates(["name"])

    def store(batches):
        files, base = fs.FileSystem.from_uri(root)
        files.create_dir(f"{base}/bronze/sha256", recursive=True)
        for batch in batches:
            new = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place = f"{base}/bronze/sha256/{name}"
                new.append(files.get_file_info(place).type == fs.FileType.NotFound)
                if new[-1]:
                    part = f"{base}/parts-{uuid.uuid4().hex}"
                    with files.open_output_stream(part) as out:
                        out.write(content.as_buffer())
                    files.move(part, place)
            keys = pa.array([f"sha256:{n}" for n in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(c.as_buffer()) for c in batch.column(1)], pa.int64()), pa.array(new, pa.bool_())], ["bronze_key", "length", "put"])

    return written(distinct.mapInArrow(store, "bronze_key string, length long, put boolean"))


def scan_bronze(spark: SparkSession, root: str) -> DataFrame:
    """(bronze_key, content, length, intact) of every stored object; intact: its name is its digest.  Spark lists no files without bytes, so the empty object is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/bronze/sha256")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.endswith(".meta.json")).select(F.concat(F.lit("sha256:"), name).alias("bronze_key"), "content", "length", (F.sha2("content", 256) == name).alias("intact"))


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, torn lines are kept with their text in _torn, and _ref names the file."""
    lines = spark.read.schema(f"{schema}, _torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    return lines.withColumn("_ref", F.col("_metadata.file_name"))


def new_only(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key the store does not have, one per key: a conflict-ignoring insert."""
    return rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def append_silver(rows: DataFrame, path: str) -> None:
    """Appends observations, partitioned by run, so that a run's scan reads its own files."""
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def export_run(parts: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Writes each part of a run as JSON lines, then adds a pointer to it: readers see all of a run or the one before, never none."""
    spark = next(iter(parts.values())).sparkSession
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{run_id}/{name}")
    spark.range(1).select(F.lit(run_id).alias("run_id"), F.unix_micros(F.current_timestamp()).alias("at_us")).write.mode("append").json(f"{path}/latest")


def latest_run(spark: SparkSession, path: str) -> str:
    """The run that was exported last."""
    return spark.read.schema("run_id string, at_us long").json(f"{path}/latest").orderBy(F.desc("at_us"), F.desc("run_id")).first()[0]
