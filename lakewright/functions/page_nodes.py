"""Pages as rows of nodes: listings laid out as repeated blocks, and elements picked by selectors.

`nodes` parses every page once, in the tasks, into one row per element and one per text.  A row holds its place in document order
(`node`) and the last place inside it (`last`), so that containment is a comparison of numbers: windows over a page's nodes in
order find what lies inside what, and no pairs of nodes are made.  The rest is DataFrame work.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.plans.registry import query
from lakewright.plans.written import written

#: Elements that have no end, and those whose text nobody reads.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNREAD = frozenset("script style template rt rp".split())
TEXT = "#text"
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "a")
TITLE_LABEL, LINK_LABEL = "record title", "record link"

_FIELDS = (
    ("node", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("place", pa.int32()), ("siblings", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("classes", pa.string()), ("classed", pa.int32()), ("text", pa.string()), ("texts_before", pa.int32()), ("texts_inside", pa.int32()),
)
NODES = "node int, last int, parent int, place int, siblings int, tag string, attrs map<string,string>, classes string, classed int, text string, texts_before int, texts_inside int"


class _Reader(HTMLParser):
    """Rows of one page. An end tag closes down to the nearest open element of its name; one that closes nothing is passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.names: Counter[str] = Counter()
        self.children: Counter[int] = Counter()
        self.said: list[str] = []
        self.texts = self.classed = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.said).split())
        self.said.clear()
        if text and not any(self.names[t] for t in UNREAD):
            self.rows.append({"node": len(self.rows), "last": len(self.rows), "parent": self.open[-1]["node"] if self.open else -1, "tag": TEXT, "text": text, "texts_before": self.texts, "texts_inside": 1})
            self.texts += 1

    def handle_starttag(self, tag, attrs):
        self._flush()
        parent = self.open[-1]["node"] if self.open else -1
        self.children[parent] += 1
        held = {k: v or "" for k, v in attrs}
        row = {"node": len(self.rows), "last": len(self.rows), "parent": parent, "place": self.children[parent], "tag": tag, "attrs": list(held.items()), "texts_before": self.texts, "texts_inside": 0}
        if "class" in held:
            self.classed += 1
            row |= {"classes": " ".join(sorted(held["class"].split())), "classed": self.classed}
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(row)
            self.names[tag] += 1

    def handle_data(self, data):
        self.said.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = handle_comment

    def handle_endtag(self, tag):
        self._flush()
        while self.names[tag]:
            if self._close() == tag:
                break

    def _close(self) -> str:
        row = self.open.pop()
        self.names[row["tag"]] -= 1
        row["last"], row["texts_inside"] = len(self.rows) - 1, self.texts - row["texts_before"]
        return row["tag"]

    def read(self, html: str | None) -> list[dict]:
        self.feed(html or "")
        self.close()
        self._flush()
        while self.open:
            self._close()
        for row in self.rows:
            row["siblings"] = self.children[row["parent"]]
        return self.rows


def nodes(pages: DataFrame) -> DataFrame:
    """(page_id, node, last, parent, place, siblings, tag, attrs, classes, classed, text, texts_before, texts_inside) of pages(page_id, html).

    parent is -1 at the top; place is the element's number among its parent's elements, siblings their count; classes are sorted and null
    without the attribute; classed numbers the elements that have it; texts are numbered through the page.  Texts hold single
    spaces; white space alone is none, nor is what scripts, styles, templates and ruby notes hold.  A null page has no nodes.  A page_id
    names one page: rows that share one must be told apart first.
    What follows reads nodes several times: write them once, or every reading parses the pages anew.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def made(keys, owners, rows):
        return pa.RecordBatch.from_arrays([keys.take(pa.array(owners, pa.int64())), *(pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS)], ["page_id", *(n for n, _ in _FIELDS)])

    def run(batches):
        for batch in batches:
            owners, rows = [], []
            for i, html in enumerate(batch.column(1)):
                page = _Reader().read(html.as_py())
                owners += [i] * len(page)
                rows += page
                if len(rows) >= 20_000:
                    yield made(batch.column(0), owners, rows)
                    owners, rows = [], []
            yield made(batch.column(0), owners, rows)

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, {NODES}")


def listings(found: DataFrame, records: int = 3, fields: int = 3, most_fields: int = 40, elements: int = 20_000, title_chars: int = 160) -> DataFrame:
    """(page_id, record, title, link, fields): the listing of every page of nodes that has one.

    A listing is a group of elements of one tag and one set of classes.  Members inside another member are left out; a group counts if
    it has that many members, before and after, and each left holds that many texts.  Of a page's groups the one with
    most texts (at most most_fields a member) is the listing, of equal ones that which begins first.  A title is the text of a record's first heading or link
    that has one, a link its first href; both may be empty.  elements bounds the elements with classes that are looked at, in order.
    """
    page, of_group = Window.partitionBy("page_id").orderBy("node"), Window.partitionBy("page_id", "tag", "classes").orderBy("node")
    before = of_group.rowsBetween(Window.unboundedPreceding, -1)
    grouped = found.where((F.col("tag") != TEXT) & (F.col("classed") <= elements))
    members = grouped.select("page_id", "tag", "classes", "node", "last", "texts_before", "texts_inside", (F.coalesce(F.max("last").over(before), F.lit(-1)) >= F.col("node")).alias("nested"))
    own = lambda c: F.when(~F.col("nested"), c)
    scored = members.groupBy("page_id", "tag", "classes").agg(
        F.count("*").alias("members"), F.count(own(F.lit(1))).alias("records"), F.min(own(F.col("texts_inside"))).alias("fewest"), F.min("node").alias("first"),
        F.sum(own(F.least("texts_inside", F.lit(most_fields)) + 2)).alias("score"),
    ).where((F.col("members") >= records) & (F.col("records") >= records) & (F.col("fewest") >= fields))
    best = scored.groupBy("page_id").agg(F.max_by(F.struct("tag", "classes"), F.struct("score", -F.col("first"))).alias("best")).select("page_id", "best.tag", "best.classes")
    chosen = members.where("not nested").join(best, ["page_id", "tag", "classes"]).select("page_id", "node", F.struct("node", "last", "texts_before").alias("member"))
    wanted = found.where(F.col("tag").isin(TEXT, *HEADINGS)).select("page_id", "node", "tag", "text", F.col("attrs")["href"].alias("href"), "texts_before", "texts_inside", F.lit(None).cast(chosen.schema["member"].dataType).alias("member"))
    # a record's own row comes before the row of the same node, so that a record that is a link is not inside itself
    rows = wanted.unionByName(chosen, allowMissingColumns=True).withColumn("in", F.last("member", True).over(page.orderBy("node", F.col("member").isNull())))
    inside = rows.where(F.col("member").isNull() & (F.col("node") > F.col("in.node")) & (F.col("node") <= F.col("in.last")))
    text = F.when(F.col("tag") == TEXT, F.struct("node", "text"))
    heading = F.when((F.col("tag") != TEXT) & (F.col("texts_inside") > 0), F.col("node"))
    link = F.when((F.col("tag") == "a") & F.col("href").isNotNull(), F.col("node"))
    made = inside.groupBy("page_id", "in").agg(
        F.transform(F.array_sort(F.collect_list(text)), lambda x: x["text"]).alias("all"), F.min_by(F.struct("texts_before", "texts_inside"), heading).alias("head"), F.min_by("href", link).alias("link")
    )
    title = F.coalesce(F.array_join(F.slice("all", F.col("head.texts_before") - F.col("in.texts_before") + 1, F.col("head.texts_inside")), " "), F.lit(""))
    record = F.row_number().over(Window.partitionBy("page_id").orderBy("in.node"))
    return made.select("page_id", record.alias("record"), F.substring(title, 1, title_chars).alias("title"), F.substring(F.coalesce("link", F.lit("")), 1, 2048).alias("link"), F.slice("all", 1, most_fields).alias("fields"))


def listing_labels(records: DataFrame, share: float = 0.6, named: float = 0.8, chars: int = 40, most: int = 30) -> DataFrame:
    """(page_id, labels) of listings: the texts that most records hold, in the order in which they come first.

    If most records have a title and most titles differ, two labels for title and link come before them.
    """
    counts = records.groupBy("page_id").agg(F.count("*").alias("records"), F.count(F.when(F.col("title") != "", 1)).alias("titled"), F.countDistinct(F.when(F.col("title") != "", F.col("title"))).alias("titles"))
    texts = records.select("page_id", "record", F.posexplode("fields").alias("at", "text")).groupBy("page_id", "text").agg(F.count("*").alias("n"), F.min(F.struct("record", "at")).alias("first"))
    kept = texts.join(counts.select("page_id", "records"), "page_id").where((F.col("n") >= share * F.col("records")) & (F.char_length("text") <= chars) & F.col("text").rlike(r"\p{L}"))
    listed = kept.groupBy("page_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), 1, most - 2).alias("labels"))
    own = (F.col("titled") >= named * F.col("records")) & (F.col("titles") >= named * F.col("titled"))
    heads = F.when(own, F.array(F.lit(TITLE_LABEL), F.lit(LINK_LABEL))).otherwise(F.array().cast("array<string>"))
    return counts.join(listed, "page_id", "left").select("page_id", F.concat(heads, F.coalesce("labels", F.array().cast("array<string>"))).alias("labels"))


_PART = re.compile(r"""(?P<sign>[#.])(?P<name>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\]\s]+))\s*)?\]|:(?P<child>first-child|last-child|nth-child\(\s*(?P<nth>\d+)\s*\))|(?P<tag>\*|[A-Za-z][\w-]*)""")
_STEP = re.compile(r"""\s*([>+~])\s*|\s+|((?:\[(?:"[^"]*"|'[^']*'|[^\]])*\]|\([^)]*\)|[^\s>+~\[(])+)""")
_COMMA = re.compile(r""",(?![^\[]*\])""")


def _compound(text: str) -> Column:
    """The condition on a node's row that a compound selector (tag, #id, .class, [attribute], :nth-child) states."""
    held, at = F.col("tag") != TEXT, 0
    for m in iter(lambda: _PART.match(text, at), None):
        attr = F.col("attrs")[m["attr"] or "id"]
        value = next((m[g] for g in "abc" if m[g] is not None), "")
        if m["tag"]:
            held &= F.lit(True) if m["tag"] == "*" else F.col("tag") == m["tag"].lower()
        elif m["sign"] == "#":
            held &= attr == m["name"]
        elif m["sign"]:
            held &= F.array_contains(F.split("classes", " "), m["name"])
        elif m["child"]:
            held &= F.col("place") == (F.col("siblings") if m["child"] == "last-child" else F.lit(int(m["nth"] or 1)))
        elif not m["op"]:
            held &= attr.isNotNull()
        else:
            tests = {"=": attr == value, "^=": attr.startswith(value), "$=": attr.endswith(value), "*=": attr.contains(value), "~=": F.array_contains(F.split(attr, r"\s+"), value), "|=": (attr == value) | attr.startswith(f"{value}-")}
            held &= tests[m["op"]] & F.lit(bool(value) or m["op"] in ("=", "|="))
        at = m.end()
    if at < len(text) or not text:
        raise ValueError(f"not a selector: {text!r}")
    return F.coalesce(held, F.lit(False))


def _steps(selector: str) -> list[tuple[str, Column]]:
    steps, way, at = [], "", 0
    selector = selector.strip()
    while at < len(selector):
        m = _STEP.match(selector, at)
        if not m:
            raise ValueError(f"not a selector: {selector!r}")
        at = m.end()
        if m[2]:
            steps.append((way, _compound(m[2])))
            way = ""
        elif not steps or (way.strip() and m[1]):
            raise ValueError(f"not a selector: {selector!r}")
        else:
            way = m[1] or way or " "
    if way or not steps:
        raise ValueError(f"not a selector: {selector!r}")
    return steps


def selected(found: DataFrame, selector: str) -> DataFrame:
    """(page_id, node, tag, attrs, text): the elements of nodes that a selector picks, each once, with the texts inside joined by spaces.

    Knows tag, *, #id, .class, [attribute] with = ~= |= ^= $= *=, :first-child, :last-child, :nth-child(n), the combinators
    (inside, >, + and ~) and commas.  ValueError for any other.
    """
    hits = None
    for alternative in _COMMA.split(selector):
        (_, start), *rest = _steps(alternative)
        rows = found.where(F.col("tag") != TEXT).withColumn("hit", start)
        for way, held in rest:
            page, near = Window.partitionBy("page_id").orderBy("node"), Window.partitionBy("page_id", "parent").orderBy("node")
            if way == " ":
                reached = F.max(F.when(F.col("hit"), F.col("last"))).over(page.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("node")
            elif way == ">":
                rows = rows.join(rows.where("hit").select("page_id", F.col("node").alias("parent"), F.lit(True).alias("above")), ["page_id", "parent"], "left")
                reached = F.col("above")
            else:
                reached = F.lag("hit").over(near) if way == "+" else F.max("hit").over(near.rowsBetween(Window.unboundedPreceding, -1))
            rows = rows.withColumn("hit", F.coalesce(reached, F.lit(False)) & held).drop("above")
        own = rows.where("hit").select("page_id", "node", "tag", "attrs", "texts_before", "texts_inside")
        hits = own if hits is None else hits.union(own)
    texts = found.where(F.col("tag") == TEXT).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]).alias("texts"))
    text = F.coalesce(F.array_join(F.slice("texts", F.col("texts_before") + 1, F.col("texts_inside")), " "), F.lit(""))
    return hits.dropDuplicates(["page_id", "node"]).join(texts, "page_id", "left").select("page_id", "node", "tag", "attrs", text.alias("text"))


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html): a page per customer with a menu and a card per order, each card with a block of facts inside."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    card = F.concat(
        F.lit('<div class="order card"><h3><a href="/orders/'), F.col("o_orderkey"), F.lit('">Order '), F.col("o_orderkey"), F.lit('</a></h3><div class="facts"><span>Status</span><span>'), F.col("o_orderstatus"),
        F.lit("</span><br><span>Priority</span><span>"), F.col("o_orderpriority"), F.lit("</span></div></div>"),
    )
    cards = o.groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", card.alias("card")))), lambda x: x["card"]), "\n").alias("cards"))
    menu = '<nav><ul><li class="menu"><a href="/">Home</a></li><li class="menu"><a href="/a">About</a></li><li class="menu"><a href="/c">Contact</a></li></ul></nav>'
    return cards.select("page_id", F.concat(F.lit(f"<html><body>{menu}<main>"), "cards", F.lit("</main></body></html>")).alias("html"))


@query(
    "listing_records",
    """SELECT o_custkey AS page_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS record, 'Order ' || o_orderkey AS title, '/orders/' || o_orderkey AS link,
    concat_ws('|', 'Order ' || o_orderkey, 'Status', o_orderstatus, 'Priority', o_orderpriority) AS fields FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 3""",
)
def listing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of every customer's page that lists three orders or more."""
    return listings(written(nodes(order_pages(spark, sf_dir)))).withColumn("fields", F.array_join("fields", "|"))


@query(
    "picked_links",
    """SELECT page_id, regexp_extract(a, '"([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<>]*)</a>', 1)) AS text, count(*) AS n
    FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li><a href="[^"]*">[^<]*</a>')) AS a FROM pages) GROUP BY ALL""",
)
def picked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links in the lists of every page's menu, by address and text."""
    found = selected(written(nodes(spark.read.parquet(f"{sf_dir}/pages.parquet"))), "nav li > a[href]")
    return found.groupBy("page_id", F.col("attrs")["href"].alias("href"), "text").agg(F.count("*").alias("n"))


@query("html_repeated_blocks")
def html_repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of every page that has one, with its labels."""
    records = written(listings(written(nodes(spark.read.parquet(f"{sf_dir}/pages.parquet")))))
    return records.join(listing_labels(records), "page_id")
