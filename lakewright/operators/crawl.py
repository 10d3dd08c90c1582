"""Crawls of many sites over a table of responses, under a policy: robots rules, domains, depth, pages, redirects, sizes.

Every site has its own queue, first in first out.  A level of all sites is one step: its pages are numbered as their queues have them, cut at the
sites' budgets, followed over redirects, and cut at the first page of a site that stops it; their links make the next level.  The loop ends when no
site has a page left.  What a site may attempt bounds every window; links are made unique by partial aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType
from pyspark.sql.window import Window

from lakewright.plans.registry import query
from lakewright.plans.written import written

#: How links to files, next pages and searches are told, and pages that ask for a person.
FILES = re.compile(r"\.(?:pdf|csv|xlsx?|docx?|zip|json|xml)(?:$|\?)")
NEXT = re.compile(r"\b(next|older|more results|page\s*\d+)\b")
SEARCH = re.compile(r"/(?:search|find|query)(?:/|$)")
LOGIN = r"(?i)(?:^|/)(?:login|log-in|signin|sign-in|authenticate|auth)(?:/|$)"
PERSON = r"(?i)\b(?:captcha|recaptcha|hcaptcha|verify you are human|robot check)\b"
PASSWORD = r"(?i)<input\b[^>]*\btype\s*=\s*['\"]?password\b"
MOVED = (301, 302, 303, 307, 308)


@dataclass(frozen=True)
class Policy:
    """What a crawl may do; longest: of the robots rules that match a path the longest decides (allow before disallow), else the first."""

    max_depth: int = 2
    page_cap: int = 30
    max_redirects: int = 5
    max_redirects_total: int = 100
    max_bytes: int = 512 * 1024
    agent: str = "LakewrightSpider"
    longest: bool = True


class _Links(HTMLParser):
    """Links outside forms, with their kind."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.forms = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "form":
            self.forms += 1
        elif tag in ("a", "area") and not self.forms:
            names = {k: v or "" for k, v in attrs}
            if href := names.get("href", "").strip():
                self.links.append((href, self._kind(href, names)))

    def handle_endtag(self, tag):
        if tag == "form" and self.forms:
            self.forms -= 1

    @staticmethod
    def _kind(href: str, names: dict[str, str]) -> str:
        rel = names.get("rel", "").casefold().split()
        try:
            path = urlsplit(href).path.casefold()
        except ValueError:
            path = ""
        if "download" in names or FILES.search(path):
            return "download"
        hint = " ".join([*rel, names.get("aria-label", ""), names.get("title", ""), names.get("class", "")]).casefold()
        return "paginate" if "next" in rel or NEXT.search(hint) else "search_results" if SEARCH.search(path) else "navigate"


def resolve(base: str, href: str) -> str | None:
    """An address in full, without its fragment; None if it is none."""
    try:
        return urldefrag(urljoin(base, href.strip()))[0]
    except ValueError:
        return None


def links_of(html: str, base: str) -> Iterator[tuple[int, str, str]]:
    """(position, address, kind) of a page's links, each address once."""
    parser, seen = _Links(), set()
    parser.feed(html)
    for href, kind in parser.links:
        to = resolve(base, href)
        if to is not None and to not in seen:
            seen.add(to)
            yield len(seen), to, kind


def robots_rules(text: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, regular expression) of the rules for an agent: those of the groups that name it, else those for all; * and $ in paths as usual."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    names, open_group = [], False
    for line in text.splitlines():
        field, _, value = line.partition("#")[0].partition(":")
        field, value = field.strip().casefold(), value.strip()
        if field == "user-agent":
            names = [*names, value.casefold()] if open_group else [value.casefold()]
            open_group = True
            for name in names:
                groups.setdefault(name, [])
        elif field in ("allow", "disallow"):
            open_group = False
            if value:
                pattern = "^" + ".*".join(re.escape(p) for p in value.removesuffix("$").split("*")) + ("$" if value.endswith("$") else "")
                for name in names:
                    groups[name].append((field == "allow", pattern))
    own = [rules for name, rules in groups.items() if name != "*" and name in agent.casefold()]
    return [r for rules in own for r in rules] if own else groups.get("*", [])


@pandas_udf(StringType())
def _resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, h) if b is not None and h is not None else None for b, h in zip(base, href, strict=True)], dtype=object)


@pandas_udf(ArrayType(StructType().add("allow", BooleanType()).add("pattern", StringType())))
def _rules(text: pd.Series, agent: pd.Series) -> pd.Series:
    return pd.Series([[{"allow": a, "pattern": p} for a, p in robots_rules(t or "", n)] for t, n in zip(text, agent, strict=True)])


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def inside(url: Column, domain: Column) -> Column:
    """Whether an address is one of the web below a domain, without credentials."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?#@:]+)(?::\d*)?(?:[/?#]|$)", 1)), r"\.$", "")
    return (host != "") & ((host == domain) | F.endswith(host, F.concat(F.lit("."), domain)))


def robots_states(responses: DataFrame, policy: Policy) -> DataFrame:
    """(origin, open, rules) of the robots files among responses: open files have rules, client errors but 429 allow all, all else stops a site."""
    files = responses.where(F.col("url").rlike(r"^[A-Za-z]+://[^/?#]+/robots\.txt$"))
    none = (F.col("status").between(400, 499)) & (F.col("status") != 429)
    read = F.col("status").between(200, 299)
    body = F.when(read, F.col("body")).otherwise("")
    return files.select(origin(F.col("url")).alias("origin"), F.coalesce(none | read, F.lit(False)).alias("open"), _rules(body, F.lit(policy.agent)).alias("rules"))


def _allowed(url: Column, policy: Policy) -> Column:
    """Whether rules, a column, allow an address."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    hits = F.filter("rules", lambda r: F.rlike(path, r["pattern"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))["allow"] if policy.longest else F.get(hits, F.lit(0))["allow"]
    return F.coalesce(best, F.lit(True))


def _followed(attempts: DataFrame, responses: DataFrame, robots: DataFrame, policy: Policy) -> DataFrame:
    """attempts(site, domain, url, place, ...) with final_url, chain, status, content_type, body, hops, blocked: each followed over its redirects."""
    facts = [c for c in attempts.columns]
    todo = attempts.withColumn("at", F.col("url")).withColumn("chain", F.array("url")).withColumn("hops", F.lit(0))
    known = responses.select(F.col("url").alias("at"), "status", "location", "content_type", "body", F.lit(True).alias("_there"))
    done = None
    while True:
        asked = todo.withColumn("origin", origin(F.col("at"))).join(robots, "origin", "left")
        # an origin without a robots file among the responses has none: it allows all
        asked = asked.withColumn("blocked", F.when(~F.coalesce("open", F.lit(True)), "robots_unavailable").when(F.col("rules").isNotNull() & ~_allowed(F.col("at"), policy), "robots_disallow"))
        got = asked.drop("open", "rules", "origin").join(known, "at", "left").withColumn("status", F.coalesce("status", F.when(F.col("_there").isNull(), 404))).drop("_there")
        moved = F.col("blocked").isNull() & F.coalesce(F.col("status").isin(*MOVED), F.lit(False))
        target = _resolved(F.col("at"), F.when(moved & (F.trim(F.coalesce("location", F.lit(""))) != ""), F.col("location")))
        got = written(got.withColumn("moved", moved).withColumn("target", target))
        why = (
            F.when(F.col("moved") & F.col("target").isNull(), "redirect_without_location").when(F.col("moved") & ~inside(F.col("target"), F.col("domain")), "redirect_outside_registrable_domain")
            .when(F.col("moved") & (F.col("hops") >= policy.max_redirects), "redirect_limit")
        )
        over = (F.col("blocked").isNull() & F.col("moved") & F.coalesce(inside(F.col("target"), F.col("domain")), F.lit(False))).cast("int")
        got = got.withColumn("blocked", F.coalesce("blocked", why)).withColumn("hops", F.col("hops") + over)
        ends = got.where("blocked IS NOT NULL OR NOT moved").select(*facts, F.col("at").alias("final_url"), "chain", "hops", "blocked", *(F.when(~F.coalesce(F.col("blocked").startswith("robots"), F.lit(False)), F.col(c)).alias(c) for c in ("status", "content_type", "body")))
        done = ends if done is None else done.union(ends)
        todo = got.where("blocked IS NULL AND moved").select(*facts, F.col("target").alias("at"), F.concat("chain", F.array("target")).alias("chain"), "hops")
        if not todo.limit(1).count():
            return done


def _judged(pages: DataFrame, spent: DataFrame, policy: Policy) -> DataFrame:
    """Followed pages with why they are blocked and whether they stop their site; pages behind a site's first stop are left out."""
    order = Window.partitionBy("site").orderBy("place")
    redirects = F.sum("hops").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("redirects", F.lit(0))
    status, body = F.col("status"), F.coalesce("body", F.lit(""))
    told = pages.join(spent.select("site", "redirects"), "site", "left").withColumn("_all", redirects)
    limit = (F.col("hops") > 0) & (F.col("_all") > policy.max_redirects_total)
    robots = F.coalesce(F.col("blocked").startswith("robots"), F.lit(False))
    blocked = F.when(robots, F.col("blocked")).when(limit, "redirect_limit").otherwise(F.col("blocked"))
    blocked = F.coalesce(blocked, F.when(F.octet_length(body) > policy.max_bytes, "response_too_large"))
    blocked = F.coalesce(blocked, F.when(status.isNull() & ~robots, "network_error").when(status.isin(401, 403), "login_or_captcha"))
    fine = status.between(200, 299) & blocked.isNull() & F.lower(F.coalesce("content_type", F.lit(""))).rlike("^(text/html|application/xhtml)")
    path = F.regexp_extract("final_url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    person = path.rlike(LOGIN) | body.rlike(PERSON) | body.rlike(PASSWORD)
    told = told.withColumn("_why", blocked).withColumn("html", F.coalesce(fine, F.lit(False)))
    stop = F.when(F.col("_why") == "robots_unavailable", "robots").when(status.isNull() & ~robots, "network_error").when(status.isin(401, 403), "login_or_captcha").when(F.col("html") & person, "login_or_captcha")
    told = told.withColumn("stop", stop).withColumn("_first", F.min(F.when(F.col("stop").isNotNull(), F.col("place"))).over(Window.partitionBy("site")))
    return told.where("_first IS NULL OR place <= _first").withColumn("blocked", F.col("_why")).withColumn("html", F.col("html") & F.col("stop").isNull()).drop("_why", "_first", "_all", "redirects")


def _page_links(pages: DataFrame) -> DataFrame:
    """(site, domain, place, from_url, depth, position, to_url, kind) of the links of pages."""

    def run(batches):
        for batch in batches:
            site, domain, place, url, depth, body = (c.to_pylist() for c in batch.columns)
            rows = [(site[i], domain[i], place[i], url[i], depth[i], *link) for i in range(len(batch)) for link in links_of(body[i] or "", url[i])]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["site", "domain", "place", "from_url", "depth", "position", "to_url", "kind"])

    return pages.select("site", "domain", "place", "final_url", "depth", "body").mapInArrow(run, "site string, domain string, place long, from_url string, depth int, position int, to_url string, kind string")


@dataclass
class Crawl:
    """pages(site, place, url, final_url, chain, depth, status, kind, parent_url, blocked), edges(site, from_url, to_url, kind, followed, reason, place, position), sites(site, attempted, redirects, stop_reason)."""

    pages: DataFrame
    edges: DataFrame
    sites: DataFrame


def crawl(seeds: DataFrame, responses: DataFrame, policy: Policy = Policy()) -> Crawl:
    """Crawls seeds(site, url, domain) over responses(url, status, location, content_type, body); seeds outside their domain are left out.

    An address without a response is answered 404; a response without a status is a network error.  Edges say why they were not followed: another domain, depth_limit, already_queued, page_cap,
    robots, redirect or status reasons, or pending where the site stopped before.
    """
    responses = responses.dropDuplicates(["url"])
    robots = written(robots_states(responses, policy))
    level = written(seeds.where(inside(F.col("url"), F.col("domain"))).select("site", "domain", "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"), F.lit("navigate").alias("kind"), F.lit(0).cast("long").alias("_o"), F.lit(0).alias("_p")).dropDuplicates(["site"]))
    sites = written(level.select("site", F.lit(0).cast("long").alias("attempted"), F.lit(0).cast("long").alias("redirects"), F.lit(None).cast("string").alias("stop")))
    queued, pages, edges, left = level.select("site", "url"), None, None, None
    for depth in range(policy.max_depth + 1):
        order = Window.partitionBy("site").orderBy("_o", "_p")
        waiting = level.join(sites.where("stop IS NULL"), "site").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= policy.page_cap)
        attempts = waiting.where(F.col("_n") + F.col("attempted") <= policy.page_cap).select("site", "domain", "url", "depth", "parent_url", "kind", (F.col("_n") + F.col("attempted")).alias("place"))
        told = written(_judged(_followed(attempts, responses, robots, policy), sites, policy))
        done = told.groupBy("site").agg(F.count("*").alias("_a"), F.sum("hops").alias("_r"), F.max("stop").alias("_s"))
        counts = level.groupBy("site").agg(F.count("*").alias("_w"))
        sites = written(sites.join(done, "site", "left").join(counts, "site", "left").select("site", (F.col("attempted") + F.coalesce("_a", F.lit(0))).alias("attempted"), (F.col("redirects") + F.coalesce("_r", F.lit(0))).alias("redirects"), F.coalesce("stop", "_s", F.when(F.coalesce("_w", F.lit(0)) > F.coalesce("_a", F.lit(0)), "page_cap")).alias("stop")))
        pages = told if pages is None else pages.union(told)
        links = written(_page_links(told.where("html")).withColumn("reason", F.when(~F.col("to_url").rlike("^https?://[^/?#@]*([/?#]|$)"), "unsafe_scheme_or_credentials").when(~inside(F.col("to_url"), F.col("domain")), "cross_registrable_domain")))
        if depth == policy.max_depth:
            links = links.withColumn("reason", F.coalesce("reason", F.lit("depth_limit")))
            edges = links if edges is None else edges.union(links)
            break
        firsts = links.where("reason IS NULL").groupBy("site", F.col("to_url").alias("url")).agg(F.min(F.struct("place", "position")).alias("f"), F.min_by(F.struct("domain", "depth", "from_url", "kind"), F.struct("place", "position")).alias("x"))
        fresh = written(firsts.join(queued, ["site", "url"], "left_anti").select("site", "x.domain", "url", (F.col("x.depth") + 1).alias("depth"), F.col("x.from_url").alias("parent_url"), "x.kind", F.col("f.place").alias("_o"), F.col("f.position").alias("_p")))
        marked = links.join(fresh.select("site", F.col("url").alias("to_url"), F.col("_o").alias("place"), F.col("_p").alias("position"), F.lit(True).alias("_new")), ["site", "to_url", "place", "position"], "left")
        links = marked.withColumn("reason", F.when(F.col("reason").isNull(), F.when(F.col("_new"), "pending").otherwise("already_queued")).otherwise(F.col("reason"))).select(links.columns)
        edges = links if edges is None else edges.union(links)
        queued, level = queued.union(fresh.select("site", "url")), fresh
        if not level.limit(1).count():
            break
    status = F.col("status")
    settled = pages.select("site", F.col("parent_url").alias("from_url"), F.col("url").alias("to_url"), (~F.coalesce(F.col("blocked").startswith("robots"), F.lit(False))).alias("_went"), F.coalesce("blocked", F.when(~status.between(200, 299), F.concat(F.lit("http_"), status.cast("string")))).alias("_why"), F.lit(True).alias("_settled"))
    shown = edges.join(settled, ["site", "from_url", "to_url"], "left").join(sites.select("site", "stop"), "site", "left")
    pending = F.col("reason") == "pending"
    reason = F.when(pending & F.col("_settled"), F.col("_why")).when(pending & (F.col("stop") == "page_cap"), "page_cap").otherwise(F.col("reason"))
    all_edges = written(shown.select("site", "from_url", "to_url", "kind", F.coalesce(pending & F.col("_settled") & F.col("_went"), F.lit(False)).alias("followed"), reason.alias("reason"), "place", "position"))
    deep = all_edges.join(pages.select("site", "place", "depth"), ["site", "place"]).where(F.col("depth") >= policy.max_depth).select("site").distinct().withColumn("_deep", F.lit(True))
    ends = sites.join(deep, "site", "left").select("site", "attempted", "redirects", F.coalesce("stop", F.when(F.col("_deep"), "depth_limit"), F.lit("queue_exhausted")).alias("stop_reason"))
    return Crawl(pages.select("site", "place", "url", "final_url", "chain", "depth", "status", "kind", "parent_url", "blocked"), all_edges, ends)


def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, status, location, content_type, body, host, r, n): the pages of each host as a linked site, with redirects, refusals and robots files among them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    place = pages.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy("page_id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("host"))).withColumn("h", F.min("page_id").over(Window.partitionBy("host")))
    r, n = F.col("r"), F.col("n")
    link = lambda to: F.concat(F.lit('<a href="/p/'), F.pmod(to, n).cast("string"), F.lit('">x</a>'))
    body = F.concat(link(r * 2 + 1), link(r * 2 + 2), link(r * 3 + 1), F.lit('<a rel="next" href="../p/'), F.pmod(r + 1, n).cast("string"), F.lit('#end">y</a><a href="https://elsewhere.example.org/">z</a><a href="mailto:a@b.c">m</a><a href="/files/a.csv">d</a>'), "html")
    url = F.concat(F.lit("https://"), "host", F.lit("/p/"), r.cast("string"))
    moved, refused, broken = r % 11 == 7, r % 19 == 17, (r % 23 == 21)
    site = place.select(url.alias("url"), F.when(moved, 302).when(refused, 403).when(~broken, 200).alias("status"), F.when(moved, F.concat(F.lit("/p/"), F.pmod(r + 1, n).cast("string"))).alias("location"), F.lit("text/html; charset=utf-8").alias("content_type"), body.alias("body"))
    firsts = place.where("r = 0")
    rules = F.when(F.col("h") % 4 == 1, "User-agent: *\nDisallow: /p/3\nAllow: /p/30\nDisallow: /*.csv$\n").when(F.col("h") % 4 == 2, "User-agent: LakewrightSpider\nDisallow: /p/5\n\nUser-agent: *\nDisallow: /\n").otherwise("")
    robots = firsts.select(F.concat(F.lit("https://"), "host", F.lit("/robots.txt")).alias("url"), F.when(F.col("h") % 29 == 3, 503).when(F.col("h") % 4 == 0, 404).otherwise(200).alias("status"), F.lit(None).cast("string").alias("location"), F.lit("text/plain").alias("content_type"), rules.alias("body"))
    return site.union(robots)


def page_seeds(responses: DataFrame) -> DataFrame:
    host = F.regexp_extract("url", "^https://([^/]*)/p/0$", 1)
    return responses.select(host.alias("site"), "url", host.alias("domain")).where("site <> ''")


@query("crawl_pages")
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a crawl of every host attempts, in order."""
    responses = written(page_responses(spark, sf_dir))
    found = crawl(page_seeds(responses), responses, Policy(max_depth=3, page_cap=20)).pages
    return found.select("site", "place", "url", "final_url", F.size("chain").alias("chain"), "depth", "status", "kind", "blocked")


@query("crawl_edges")
def crawl_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why links were followed or not, counted by host."""
    responses = written(page_responses(spark, sf_dir))
    found = crawl(page_seeds(responses), responses, Policy(max_depth=3, page_cap=20))
    return found.edges.groupBy("site", "kind", "followed", "reason").agg(F.count("*").alias("n")).join(found.sites, "site")
