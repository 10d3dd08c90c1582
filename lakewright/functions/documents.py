"""Parsers that built-in functions cannot express, as Arrow-batched table functions over documents."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections import Counter
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.plans.registry import query

ROWS = "doc_id long, sheet string, row_number int, cells array<string>"


def _tables(docs: DataFrame, parse) -> DataFrame:
    """docs(doc_id, content) -> one row per parsed table row; a document that fails to parse gives none."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(doc_id, sheet, number, cells) for sheet, number, cells in parse(content)]
                except (ValueError, csv.Error, zipfile.BadZipFile, ElementTree.ParseError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.list_(pa.string()))], ["doc_id", "sheet", "row_number", "cells"])

    return docs.select("doc_id", "content").mapInArrow(run, ROWS)


def csv_rows(text: str):
    """Dialect sniffed from the first 4,096 characters, no letter or digit parts cells; empty rows are dropped, numbers are those of the source."""
    text = (text or "").removeprefix("\ufeff")
    try:
        dialect = csv.Sniffer().sniff(text[:4096])
        if dialect.delimiter.isalnum():  # a column of like values
            dialect = csv.Sniffer().sniff(text[:4096], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    for number, row in enumerate(csv.reader(io.StringIO(text), dialect), 1):
        if any(c.strip() for c in row):
            yield "csv", number, [c.strip() for c in row]


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.table, self.number, self.row, self.cell = [], 0, 0, None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.number = self.table + 1, 0
        elif tag == "tr":
            self.row, self.number = [], self.number + 1
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row:
            self.rows.append((f"html-table-{self.table}", self.number, self.row))
            self.row = None


def html_table_rows(html: str):
    parser = _Tables()
    parser.feed(html or "")
    return parser.rows


def shallowest_records(document):
    """(pointer, records) of the shallowest array of objects of a JSON document (ties: more objects, then the pointer), or None."""
    level, found = [("", document)], []
    while level and not found:
        found = [(-len(v), p, v) for p, v in level if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)]
        level = [(f"{p}/{k}", x) for p, v in level for k, x in (v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ())]
    return min(found, key=lambda f: f[:2])[1:] if found else None


def select_records(text: str):
    """The records of a JSON document, one row each."""
    if found := shallowest_records(json.loads(text)):
        for number, record in enumerate(found[1], 1):
            yield found[0], number, [f"{k}={v if isinstance(v, str) else json.dumps(v, sort_keys=True)}" for k, v in sorted(record.items())]


def json_bounds(text: str, depth: int = 64, items: int = 100_000) -> tuple[int, int, bool]:
    """(depth, items, within bounds) of a JSON document."""
    todo, deepest, count = [(json.loads(text), 1)], 0, 0
    while todo:
        value, at = todo.pop()
        deepest, count = max(deepest, at), count + 1
        todo += [(x, at + 1) for x in (value.values() if isinstance(value, dict) else value if isinstance(value, list) else ())]
    return deepest, count, deepest <= depth and count <= items


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_rows(content: bytes):
    """The cells of every sheet of a workbook, by their shown values."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        texts = []
        if "xl/sharedStrings.xml" in names:
            texts = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        for name in sorted(n for n in names if n.startswith("xl/worksheets/sheet")):
            for row in ElementTree.fromstring(book.read(name)).iter(f"{_SHEET}row"):
                cells = []
                for cell in row.iter(f"{_SHEET}c"):
                    value = cell.find(f"{_SHEET}v")
                    inline = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                    cells.append(texts[int(value.text)] if cell.get("t") == "s" and value is not None else inline or (value.text if value is not None else ""))
                if any(cells):
                    yield name.rpartition("/")[2].removesuffix(".xml"), int(row.get("r", "0")), cells


def zip_csv_rows(content: bytes, limit: int = 64 << 20):
    """The rows of the CSV members of an archive; an archive that expands beyond the limit fails whole."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        if sum(i.file_size for i in archive.infolist()) > limit:
            raise ValueError("the archive expands beyond the limit")
        for info in sorted(archive.infolist(), key=lambda i: i.filename):
            if info.filename.lower().endswith(".csv") and ".." not in info.filename:
                for _, number, cells in csv_rows(archive.read(info).decode("utf-8-sig", "replace")):
                    yield info.filename, number, cells


@query("html_tables")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables made of each page's links: pages hold no table of their own."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    table = F.regexp_replace(F.regexp_replace("html", "<ul>", "<table>"), "</ul>", "</table>")
    table = F.regexp_replace(F.regexp_replace(table, "<li>", "<tr><td>"), "</li>", "</td></tr>")
    return _tables(pages.select(F.col("page_id").alias("doc_id"), table.alias("content")), html_table_rows)


@query("parse_csv", "SELECT n_nationkey AS doc_id, 'csv' AS sheet, CAST(1 AS INTEGER) AS row_number, CAST(n_nationkey AS VARCHAR) || '|' || n_name AS cells FROM nation")
def parse_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit('"\n\n'))
    rows = _tables(nations.select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("content")), csv_rows)
    return rows.withColumn("cells", F.array_join("cells", "|"))


@query("json_select_records")
def json_select_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    nested = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")))).alias("lines"))
    text = F.to_json(F.struct(F.col("o_orderkey").alias("id"), "lines"))
    return _tables(orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("doc_id"), text.alias("content")), select_records)


@query("json_bounds", "SELECT event_id, 2 AS depth, 2 AS items, TRUE AS within FROM events")
def json_bounds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [json_bounds(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.bool_())], ["event_id", "depth", "items", "within"])

    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props").mapInArrow(run, "event_id long, depth int, items int, within boolean")


@query("json_shape", """SELECT event_type, '{"k":"integer"}' AS shape, count(*) AS n FROM events GROUP BY event_type""")
def json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value-free shape of each document, counted per type."""

    def shape(value):
        if isinstance(value, dict):
            return {k: shape(v) for k, v in sorted(value.items())}
        if isinstance(value, list):
            return [json.loads(s) for s in sorted({json.dumps(shape(v), sort_keys=True) for v in value[:3]})]
        return {bool: "boolean", int: "integer", float: "number", str: "string", type(None): "null"}[type(value)]

    def run(batches):
        for batch in batches:
            seen = Counter((t, json.dumps(shape(json.loads(p)), sort_keys=True, separators=(",", ":"))) for t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["event_type", "shape", "n"])

    counted = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "props").mapInArrow(run, "event_type string, shape string, n long")
    return counted.groupBy("event_type", "shape").agg(F.sum("n").alias("n"))


@query("crawl_bfs")
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first frontier over the hosts' links: (host, depth), one join per level, at most two levels."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host"))
    links = pages.crossJoin(F.broadcast(pages.agg((F.max("page_id") + 1).alias("n")))).select("host", ((F.col("page_id") * 7 + 1) % F.col("n")).alias("to"))
    edges = links.alias("a").join(pages.alias("b"), F.col("b.page_id") == F.col("a.to")).select(F.col("a.host").alias("x"), F.col("b.host").alias("y")).distinct()
    seen = pages.where("page_id = 0").select("host", F.lit(0).alias("depth"))
    for depth in (1, 2):
        reached = seen.join(edges, F.col("host") == F.col("x")).select(F.col("y").alias("host")).distinct()
        seen = seen.union(reached.join(seen, "host", "left_anti").select("host", F.lit(depth).alias("depth")))
    return seen


@query("supporting_quote")
def supporting_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of a document that holds a claim's words, here the eighth word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", r"(?<=[.!?])\s+|[\r\n]+").alias("sentences"), F.get(F.split("text", r"\s+"), F.lit(7)).alias("word"))
    return docs.where("word is not null").select("doc_id", F.get(F.filter("sentences", lambda s: F.contains(s, F.col("word"))), F.lit(0)).alias("quote"))


@query("ckan_parse")
def ckan_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue payloads (here one per host, made of its pages) to one lead per resource with a tabular format."""
    schema = "result struct<results: array<struct<name: string, title: string, resources: array<struct<url: string, format: string>>>>>"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host"))
    resource = F.struct(F.col("url"), F.when(F.col("page_id") % 2 == 0, "CSV").otherwise("HTML").alias("format"))
    hosts = pages.groupBy("host").agg(F.sort_array(F.collect_list(resource)).alias("resources"))
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("host").alias("name"), F.upper("host").alias("title"), "resources")).alias("results")).alias("result")))
    parsed = hosts.select(F.from_json(payload, schema).alias("p")).select(F.explode("p.result.results").alias("r"))
    return parsed.select("r.name", "r.title", F.explode("r.resources").alias("x")).where(F.lower("x.format").isin("csv", "json", "xlsx")).select("name", "title", "x.url", "x.format")


@query("profile_table")
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per column of a table: fill rate, distinct values, largest repeat and the first row that has a value (its receipt)."""
    table = spark.read.parquet(f"{sf_dir}/part.parquet")
    long = table.select("p_partkey", *(F.col(c).cast("string").alias(c) for c in table.columns if c != "p_partkey")).unpivot(["p_partkey"], None, "column", "value")
    values = long.where("value is not null and value <> ''").groupBy("column", "value").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    filled = values.groupBy("column").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct_values"), F.max("n").alias("max_repeat"), F.min("first").alias("first_row"))
    rows = long.groupBy("column").agg(F.count("*").alias("rows"))
    return filled.join(rows, "column").select("column", F.round(F.col("filled") / F.col("rows"), 4).alias("fill_rate"), "distinct_values", "max_repeat", "first_row")
