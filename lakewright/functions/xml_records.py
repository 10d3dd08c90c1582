"""Records of XML documents: one for every element without elements in it, made of its parent's elements."""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.plans.registry import query

RECORDS = "leaf int, names array<string>, texts array<string>, error string"


def leaf_records(content: str | bytes) -> list[tuple[int, dict[str, str]]]:
    """(number of the leaf, {name: text} of its parent's elements) in document order, read by events: no tree is kept.

    Of elements of one name the last gives the text, the first the place.  A text is that of all elements inside, each run of it without white space at its ends.
    """
    parser = expat.ParserCreate()
    parser.buffer_text = True
    # of every open element: texts so far, its elements' (name, text), and the numbers of those that are leaves
    held, found, leaves, said = [([], {}, [])], [], 0, []

    def flush(*_):
        if text := "".join(said).strip():
            held[-1][0].append(text)
        said.clear()

    def start(_name, _attributes):
        flush()
        held.append(([], {}, []))

    def close():
        texts, children, own = held.pop()
        found.extend((number, children) for number in own)
        return "".join(texts), not children

    def end(name):
        nonlocal leaves
        flush()
        text, is_leaf = close()
        held[-1][0].append(text)
        held[-1][1][name] = text
        if is_leaf:
            leaves += 1
            held[-1][2].append(leaves)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.CommentHandler = start, end, said.append, flush
    parser.Parse(content, True)
    close()
    return sorted(found, key=lambda x: x[0])


def xml_records(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, names, texts, error) of docs(doc_id, content): the records of every document, names and texts side by side.

    A document that is not well-formed gives one row with its error and no record; a null or empty one gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                content = batch.column(1)[i].as_py()
                if not content:
                    continue
                try:
                    rows = [(leaf, list(r), list(r.values()), None) for leaf, r in leaf_records(content)]
                except expat.ExpatError as e:
                    rows = [(None, None, None, str(e))]
                kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows))), *columns], ["doc_id", "leaf", "names", "texts", "error"])

    return docs.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, {RECORDS}")


@query(
    "xml_order_records",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem),
    t AS (SELECT l_orderkey, arg_max(CAST(l_linenumber AS VARCHAR) || l_partkey, i) AS line FROM l GROUP BY 1)
    SELECT o_orderkey AS doc_id, CAST(k AS INTEGER) AS leaf, 'key=' || o_orderkey || '|status=' || o_orderstatus || '|line=' || line AS record FROM orders JOIN t ON l_orderkey = o_orderkey CROSS JOIN (VALUES (1), (2)) v(k)
    UNION ALL SELECT l_orderkey, CAST(2 * i + k AS INTEGER), 'number=' || l_linenumber || '|part=' || l_partkey FROM l JOIN orders ON o_orderkey = l_orderkey CROSS JOIN (VALUES (1), (2)) v(k)""",
)
def xml_order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every order written as XML, its lines inside."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    one = F.concat(F.lit("<line><number>"), F.col("l_linenumber"), F.lit("</number>\n<part>"), F.col("l_partkey"), F.lit("</part></line>"))
    nested = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", one.alias("x")))), lambda s: s["x"]), " ").alias("lines"))
    text = F.concat(F.lit("<order><key>"), F.col("o_orderkey"), F.lit("</key><status> "), F.col("o_orderstatus"), F.lit(" </status>"), F.col("lines"), F.lit("</order>"))
    docs = orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("doc_id"), text.alias("content"))
    record = F.array_join(F.zip_with("names", "texts", lambda n, t: F.concat(n, F.lit("="), t)), "|")
    return xml_records(docs).select("doc_id", "leaf", record.alias("record"))
