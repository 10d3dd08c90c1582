"""The graph of a crawl: pages under all the addresses they answered to, their types, and the links between pages and between types."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lakewright.operators.crawl import Crawl, Policy, crawl, page_responses, page_seeds
from lakewright.plans.registry import query
from lakewright.plans.written import written

KINDS = ("navigate", "paginate", "search_results", "download")
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


class _Tags(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names = []

    def handle_starttag(self, tag, attrs):
        self.names.append(tag)


@pandas_udf(StringType())
def skeleton(html: pd.Series) -> pd.Series:
    """Digest of the names of a page's elements in their order; null without a page."""

    def one(text: str) -> str:
        parser = _Tags()
        parser.feed(text)
        return hashlib.sha256(" ".join(parser.names).encode()).hexdigest()

    return html.map(one, na_action="ignore")


def url_template(url: Column) -> Column:
    """An address with {id} in place of path segments that are numbers, UUIDs, long hexadecimal names or long names with three digits, and of its query the sorted names."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    digits = lambda s: F.length(F.regexp_replace(s, r"\D", ""))
    named = lambda s: s.rlike(r"^\d+$") | s.rlike(_UUID) | s.rlike(r"^[0-9a-fA-F]{12,}$") | ((digits(s) >= 3) & (F.length(s) >= 8))
    segments = F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(named(s), "{id}").otherwise(s)), "/")
    asked = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda q: q != "")
    names = F.array_sort(F.array_distinct(F.transform(asked, lambda q: F.coalesce(F.try_url_decode(F.regexp_extract(q, "^([^=]*)", 1)), q))))
    home = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    return F.concat(home, F.when(segments == "", "/").otherwise(segments), F.when(F.size(names) > 0, F.concat(F.lit("?"), F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("={value}"))), "&"))).otherwise(""))


@dataclass
class SiteGraph:
    """instances(site, instance_id, url, type_id, template, depth, status, kind, parent_id), edges(site, from_id, to_url, to_id, kind, risk, followed, reason), types(site, type_id, template, pages)."""

    instances: DataFrame
    edges: DataFrame
    types: DataFrame


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24))


def aliases(pages: DataFrame) -> DataFrame:
    """(site, alias, instance_id): every address that a page answered to (asked for, final, and on the way); of several pages the one fetched last."""
    ways = pages.select("site", "place", "instance_id", F.explode(F.array_union(F.array("final_url", "url"), "chain")).alias("alias"))
    return ways.groupBy("site", "alias").agg(F.max_by("instance_id", "place").alias("instance_id"))


def site_graph(found: Crawl, responses: DataFrame) -> SiteGraph:
    """The graph of a crawl; pages without a status (refused by robots rules, network errors) are not part of it.

    Pages of one final address and content are one instance; instances of one template and skeleton one type.  Redirects end at their last
    page, so a link to any address of a chain leads to it.
    """
    bodies = responses.dropDuplicates(["url"]).select(F.col("url").alias("final_url"), F.coalesce("body", F.lit("")).alias("body"), "content_type")
    media = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("application/octet-stream")), F.lit(";"), F.lit(1))))
    fetched = found.pages.where("status IS NOT NULL").join(bodies, "final_url", "left").withColumn("body", F.coalesce("body", F.lit("")))
    shape = F.when(media.isin("text/html", "application/xhtml+xml"), skeleton("body")).otherwise(F.sha2(F.concat(F.lit("binary:"), media), 256))
    named = fetched.withColumn("template", url_template(F.col("final_url"))).withColumn("skeleton", shape).withColumn("instance_id", _id("page-", F.col("final_url"), F.concat(F.lit("sha256:"), F.sha2("body", 256)))).withColumn("type_id", _id("type-", F.col("template"), F.col("skeleton")))
    pages = written(named.select("site", "place", "url", "final_url", "chain", "depth", "status", "kind", "parent_url", "template", "instance_id", "type_id"))
    known = written(aliases(pages))
    parents = known.select("site", F.col("alias").alias("parent_url"), F.col("instance_id").alias("parent_id"))
    first = pages.groupBy("site", "instance_id").agg(F.min_by(F.struct("final_url", "type_id", "template", "depth", "status", "kind", "parent_url"), "place").alias("f")).select("site", "instance_id", "f.*")
    instances = first.join(parents, ["site", "parent_url"], "left").select("site", "instance_id", F.col("final_url").alias("url"), "type_id", "template", "depth", "status", "kind", "parent_id")
    links = found.edges.where(F.col("to_url").rlike("^(?i:https?)://"))
    ends = [known.select("site", F.col("alias").alias(f"{side}_url"), F.col("instance_id").alias(f"{side}_id")) for side in ("from", "to")]
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("navigate")
    risk = F.when(F.col("reason") == "cross_registrable_domain", "LOW").otherwise("SAFE")
    edges = links.join(ends[0], ["site", "from_url"]).join(ends[1], ["site", "to_url"], "left").select("site", "from_id", "to_url", "to_id", kind.alias("kind"), risk.alias("risk"), "followed", "reason")
    types = instances.groupBy("site", "type_id", "template").agg(F.count("*").alias("pages"))
    return SiteGraph(written(instances), written(edges), types)


def type_edges(graph: SiteGraph) -> DataFrame:
    """(site, from_type, to_type, kind, followed, n): the links between types; to_type is null for links out of the graph."""
    of = graph.instances.select("site", "instance_id", "type_id")
    out = graph.edges.join(of.select("site", F.col("instance_id").alias("from_id"), F.col("type_id").alias("from_type")), ["site", "from_id"]).join(of.select("site", F.col("instance_id").alias("to_id"), F.col("type_id").alias("to_type")), ["site", "to_id"], "left")
    return out.groupBy("site", "from_type", "to_type", "kind", "followed").agg(F.count("*").alias("n"))


def crawled_graph(spark: SparkSession, sf_dir: str) -> SiteGraph:
    responses = written(page_responses(spark, sf_dir))
    return site_graph(crawl(page_seeds(responses), responses, Policy(max_depth=3, page_cap=20)), responses)


@query("site_instances")
def site_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the crawled hosts with type and parent."""
    return crawled_graph(spark, sf_dir).instances


@query("site_type_links")
def site_type_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between types of the crawled hosts."""
    return type_edges(crawled_graph(spark, sf_dir))


# templates of the pages' own addresses, by another engine's list functions
@query(
    "url_templates",
    r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS home, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages)
  SELECT page_id, lower(home) || CASE WHEN path = '' THEN '/' ELSE array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_full_match(s, '\d+') OR regexp_full_match(s, '[0-9a-fA-F]{12,}') OR (length(regexp_replace(s, '\D', '', 'g')) >= 3 AND length(s) >= 8) THEN '{id}' ELSE s END), '/') END
  || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_transform(list_sort(list_distinct(list_transform(string_split(q, '&'), lambda p: split_part(p, '=', 1)))), lambda k: k || '={value}'), '&') END AS template FROM u""",
)
def url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", url_template(F.col("url")).alias("template"))
