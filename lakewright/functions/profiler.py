"""Profiles of any table given as cells: header row, columns, patterns, fingerprint and granularity, all as DataFrame operations.

cells(sheet, row, col, cell): row and col count from 0; cells that are not there are empty.  Sheets are grouped, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.plans.registry import query

#: Pattern -> (expression, jurisdictions that it needs, or none).
PATTERNS = {
    "email": (r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$", ()),
    "url": (r"^https?://\S+$", ()),
    "date_iso": (r"^\d{4}-\d{2}-\d{2}$", ()),
    "date_slash": (r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$", ()),
    "datetime_iso": (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}", ()),
    "year": (r"^(?:19|20)\d{2}$", ()),
    "amount": (r"^\$?\s?-?\d{1,3}(?:[,\s]\d{3})*(?:\.\d{1,2})?$", ()),
    "amount_currency": (r"^\$?\s?-?\d+(?:\.\d{1,2})?\s?(?:MXN|USD|EUR|mxn|usd)$", ()),
    "percentage": (r"^-?\d+(?:\.\d+)?\s?%$", ()),
    "phone": (r"^\+?\d[\d\s().-]{6,}\d$", ()),
    "integer": (r"^\d+$", ()),
    "decimal": (r"^-?\d+\.\d+$", ()),
    "legal_suffix": (r"(?i)\b(?:S\.?A\.?\s?DE\s?C\.?V\.?|S\.?A\.?|S\.?C\.?|S\.?DE\s?R\.?L\.?(?:\s?DE\s?C\.?V\.?)?|LLC|INC\.?|CORP\.?|GMBH|LTDA|PLC)\b", ()),
    "address_hint": (r"(?i)\b(?:calle|c\.|avenida|av\.|blvd|boulevard|street|st\.|road|rd\.|colonia|col\.|cp\s?\d{4,5}|suite|no\.\s?\d+)\b", ()),
    "postal_mx": (r"^\d{5}$", ("MX",)),
    "tax_id_rfc": (r"^[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{2,3}$", ("MX",)),
    "tax_id_curp": (r"^[A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z0-9]\d$", ("MX",)),
    "tax_id_us_ein": (r"^\d{2}-\d{7}$", ("US",)),
    "postal_us": (r"^\d{5}(?:-\d{4})?$", ("US",)),
}
#: Patterns that identify a thing, and patterns of measures.
IDENTIFIERS = ("tax_id_rfc", "tax_id_curp", "tax_id_us_ein", "email", "url", "phone")
MEASURES = ("integer", "amount", "amount_currency", "decimal", "percentage")
#: Rows searched for a header, share of its cells that are filled, share of these that are text, longest cell that has patterns, sample values.
SCAN, FILLED, TEXT, LONGEST, SAMPLES = 10, 0.6, 0.6, 500, 5
#: Rows up to which a sheet without patterns is a list of things, and up to which labels with measures are totals.
SHORT, TOTALS = 8, 25


def tidy(value: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))


def patterns(value: Column, jurisdictions: tuple[str, ...] = (), extra: dict[str, str] | None = None) -> Column:
    """The names of the patterns that a tidy cell has, in the order of PATTERNS, then extra ones."""
    known = {n: p for n, (p, places) in PATTERNS.items() if not places or set(places) & set(jurisdictions)} | (extra or {})
    hits = F.array(*(F.when(value.rlike(p), F.lit(n)) for n, p in known.items()))
    return F.when((value != "") & (F.length(value) <= LONGEST), F.array_compact(hits)).otherwise(F.array().cast("array<string>"))


def header_rows(cells: DataFrame) -> DataFrame:
    """(sheet, header): the first of a sheet's first rows that is wide, filled and mostly text; else its first row that is not empty, else 0."""
    value = tidy(F.col("cell"))
    full = F.count(F.when(value != "", 1))
    texty = F.count(F.when((value != "") & ~value.rlike(r"^[\d.,%$\s-]+$"), 1)) / F.greatest(full, F.lit(1))
    shape = cells.where(F.col("row") < SCAN).groupBy("sheet", "row").agg(full.alias("full"), (F.max("col") + 1).alias("width"), texty.alias("texty"))
    good = (F.col("full") >= 2) & (F.col("full") >= FILLED * F.col("width")) & (F.col("texty") >= TEXT)
    found = shape.groupBy("sheet").agg(F.min(F.when(good, F.col("row"))).alias("good"), F.min(F.when(F.col("full") > 0, F.col("row"))).alias("first"))
    return cells.select("sheet").distinct().join(found, "sheet", "left").select("sheet", F.coalesce("good", "first", F.lit(0)).alias("header"))


def body(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, name, value) of the cells below each sheet's header, without repeats of the header row (page banners) and empty rows."""
    tidied = cells.select("sheet", "row", "col", tidy(F.col("cell")).alias("value")).join(header_rows(cells), "sheet")
    heads = tidied.where(F.col("row") == F.col("header")).select("sheet", "col", F.when(F.col("value") == "", F.concat(F.lit("column_"), (F.col("col") + 1).cast("string"))).otherwise(F.col("value")).alias("name"), F.col("value").alias("_head"))
    below = tidied.where(F.col("row") > F.col("header")).join(heads, ["sheet", "col"])
    row = Window.partitionBy("sheet", "row")
    same = F.min((F.lower("value") == F.lower("_head")).cast("int")).over(row)
    filled = F.max((F.col("value") != "").cast("int")).over(row)
    return below.withColumn("_same", same).withColumn("_filled", filled).where("_same = 0 and _filled = 1").select("sheet", "row", "col", "name", "value")


def columns(cells: DataFrame, jurisdictions: tuple[str, ...] = (), extra: dict[str, str] | None = None) -> DataFrame:
    """Per sheet and column: name, rows, fill_rate, distinct_values, is_unique, max_repeat, dominant_pattern, dominant_share, samples.

    The dominant pattern is the one of most cells; ties go to the one that is met first.  Samples are the commonest values, ties by first row.
    """
    rows = body(cells)
    key = ["sheet", "col"]
    sizes = rows.groupBy("sheet").agg(F.countDistinct("row").alias("rows"))
    values = rows.where("value <> ''").groupBy(*key, "value").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    best = Window.partitionBy(*key).orderBy(F.desc("n"), "first", "value")
    some = values.withColumn("_place", F.row_number().over(best)).groupBy(*key).agg(
        F.sum("n").alias("full"), F.count("*").alias("distinct_values"), F.max("n").alias("max_repeat"),
        F.array_sort(F.collect_list(F.when(F.col("_place") <= SAMPLES, F.struct("_place", "value")))).alias("_top"),
    )
    hits = values.select(*key, "n", "first", F.posexplode(patterns(F.col("value"), jurisdictions, extra)).alias("_at", "pattern")).groupBy(*key, "pattern").agg(F.sum("n").alias("hits"), F.min(F.struct("first", "_at")).alias("met"))
    ranked = hits.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("hits"), "met"))).where("_place = 1").select(*key, F.col("pattern").alias("dominant_pattern"), "hits")
    names = rows.groupBy(*key).agg(F.first("name").alias("name"))
    out = names.join(sizes, "sheet").join(some, key, "left").join(ranked, key, "left")
    return out.select(
        *key, "name", "rows", F.round(F.coalesce("full", F.lit(0)) / F.col("rows"), 4).alias("fill_rate"), F.coalesce("distinct_values", F.lit(0)).cast("long").alias("distinct_values"),
        F.coalesce(F.col("distinct_values") == F.col("full"), F.lit(False)).alias("is_unique"), F.coalesce("max_repeat", F.lit(0)).cast("long").alias("max_repeat"), "dominant_pattern",
        F.coalesce(F.round(F.col("hits") / F.col("full"), 4), F.lit(0.0)).alias("dominant_share"), F.coalesce(F.transform("_top", lambda x: x["value"]), F.array().cast("array<string>")).alias("samples"),
    )


def sheets(profile: DataFrame) -> DataFrame:
    """Per sheet of columns(): fingerprint of its columns' names, patterns and fill, and granularity (entity, entity_candidate or aggregate)."""
    one = F.concat_ws(":", "name", F.coalesce("dominant_pattern", F.lit("None")), F.col("fill_rate").cast("string"))
    grouped = profile.groupBy("sheet").agg(
        F.array_sort(F.collect_list(F.struct("col", one.alias("key")))).alias("_keys"), F.max("rows").alias("rows"), F.count("*").alias("columns"),
        F.count(F.when(F.col("dominant_pattern").isin(*IDENTIFIERS), 1)).alias("_ids"), F.count("dominant_pattern").alias("_patterned"), F.count(F.when(F.col("dominant_pattern").isin(*MEASURES), 1)).alias("_measures"),
        F.min_by(F.struct("is_unique", "fill_rate", "dominant_pattern"), "col").alias("_first"),
    )
    label = F.col("_first.is_unique") & (F.col("_first.fill_rate") >= 0.9) & F.col("_first.dominant_pattern").isNull()
    totals = (F.col("_measures") > 0) & (2 * F.col("_measures") >= F.col("columns")) & label & (F.col("rows") <= TOTALS)
    verdict = F.when((F.col("_ids") > 0) | ((F.col("rows") <= SHORT) & (F.col("_patterned") == 0)), "entity").when(totals, "aggregate").otherwise("entity_candidate")
    digest = F.substring(F.sha2(F.array_join(F.transform("_keys", lambda k: k["key"]), "|").cast("binary"), 256), 1, 16)
    return grouped.select("sheet", "rows", digest.alias("fingerprint"), verdict.alias("granularity"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sheets made of tables: customers and nations below a title and a header, and the sizes of segments."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")

    def sheet(name: str, frame: DataFrame, title: bool, order: str) -> DataFrame:
        top = 2 if title else 1
        at = (F.col("_at") + top).cast("long")
        numbered = frame.withColumn("_at", F.col(order).cast("long"))
        cells = F.explode(F.array(*(F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("cell")) for i, c in enumerate(frame.columns)))).alias("x")
        rows = numbered.select(at.alias("row"), cells).select(F.lit(name).alias("sheet"), "row", "x.col", "x.cell")
        head = [(name, top - 1, i, c) for i, c in enumerate(frame.columns)] + ([(name, 0, 0, f"All {name}")] if title else [])
        return rows.unionByName(spark.createDataFrame(head, "sheet string, row long, col int, cell string"))

    mail = F.concat(F.lit("c"), "c_custkey", F.lit("@x.org"))
    customers = read("customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("c_mktsegment"), mail.alias("mail"))
    nations = read("nation").select("n_name", "n_nationkey", "n_regionkey").select("n_name", "n_regionkey", "n_nationkey")
    return sheet("customers", customers, True, "c_custkey").unionByName(sheet("nations", nations, False, "n_nationkey")).select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("int").alias("col"), "cell")


@query("profiled_columns", """WITH c AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS s FROM customer)
  SELECT 'customers' AS sheet, 0 AS col, 'c_custkey' AS name, count(*) AS n_rows, 1.0::DOUBLE AS fill_rate, count(*) AS distinct_values, TRUE AS is_unique, 1::BIGINT AS max_repeat, 'integer' AS dominant_pattern, 1.0::DOUBLE AS dominant_share FROM c HAVING count(*) > 1000
  UNION ALL SELECT 'customers', 0, 'c_custkey', count(*), 1.0, count(*), TRUE, 1, 'amount', 1.0 FROM c HAVING count(*) <= 1000
  UNION ALL SELECT 'customers', 1, 'c_name', count(*), 1.0, count(DISTINCT c_name), count(DISTINCT c_name) = count(*), (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY c_name)), NULL, 0.0 FROM c
  UNION ALL SELECT 'customers', 2, 'c_mktsegment', count(*), round(count(s) / count(*), 4), count(DISTINCT s), count(DISTINCT s) = count(s), (SELECT max(n) FROM (SELECT count(*) AS n FROM c WHERE s IS NOT NULL GROUP BY s)), NULL, 0.0 FROM c
  UNION ALL SELECT 'customers', 3, 'mail', count(*), 1.0, count(*), TRUE, 1, 'email', 1.0 FROM c
  UNION ALL SELECT 'nations', 0, 'n_name', count(*), 1.0, count(DISTINCT n_name), TRUE, 1, NULL, 0.0 FROM nation
  UNION ALL SELECT 'nations', 1, 'n_regionkey', count(*), 1.0, count(DISTINCT n_regionkey), FALSE, (SELECT max(n) FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey)), 'amount', 1.0 FROM nation
  UNION ALL SELECT 'nations', 2, 'n_nationkey', count(*), 1.0, count(*), TRUE, 1, 'amount', 1.0 FROM nation""")
def profiled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of two sheets."""
    return columns(table_cells(spark, sf_dir)).drop("samples").withColumnRenamed("rows", "n_rows")


@query("profiled_sheets", "SELECT 'customers' AS sheet, count(*) AS n_rows, 'entity' AS granularity FROM customer UNION ALL SELECT 'nations', count(*), 'aggregate' FROM nation")
def profiled_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Granularity: mail addresses make a list of things; labels with measures are totals."""
    return sheets(columns(table_cells(spark, sf_dir))).drop("fingerprint").withColumnRenamed("rows", "n_rows")


@query("profiled_headers", "SELECT 'customers' AS sheet, 1 AS header UNION ALL SELECT 'nations', 0")
def profiled_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title row is passed over."""
    return header_rows(table_cells(spark, sf_dir)).select("sheet", F.col("header").cast("int").alias("header"))
