"""Crawls against a brute-force crawler that keeps queues, over the pages and over small sites."""

from collections import deque
from urllib.parse import urlsplit

import pytest

from lakewright.operators import crawl
from lakewright.operators.crawl import Policy

SEEDS, RESPONSES = "site string, url string, domain string", "url string, status int, location string, content_type string, body string"


def inside(url, domain):
    parts = urlsplit(url)
    host = (parts.hostname or "").rstrip(".")
    return parts.scheme in ("http", "https") and not parts.username and not parts.password and bool(host) and (host == domain or host.endswith("." + domain))


def allowed(rules, url, longest):
    import re

    parts = urlsplit(url)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    hits = [(len(p), a) for a, p in rules if re.search(p, path)]
    return (max(hits) if longest else hits[0])[1] if hits else True


def brute(seed, domain, responses, policy):
    """(pages, edges, attempted, stop) of one site."""
    import re

    queue, queued, robots, pages, edges = deque([(seed, 0, None, "navigate")]), {seed}, {}, [], []
    attempted = total = 0
    stop = None

    def state(url):
        parts = urlsplit(url)
        home = f"{parts.scheme}://{parts.netloc}".lower()
        if home not in robots:
            r = responses.get(home + "/robots.txt")
            if r is None or (r[0] is not None and 400 <= r[0] < 500 and r[0] != 429):
                robots[home] = (True, [])
            elif r[0] is not None and 200 <= r[0] < 300:
                robots[home] = (True, crawl.robots_rules(r[3] or "", policy.agent))
            else:
                robots[home] = (False, [])
        return robots[home]

    def settle(parent, url, followed, why):
        for e in edges:
            if e["from"] == parent and e["to"] == url and e["reason"] == "pending":
                e.update(followed=followed, reason=why)

    while queue and attempted < policy.page_cap and not stop:
        url, depth, parent, kind = queue.popleft()
        at, chain, blocked, hops, response = url, [url], None, 0, None
        while True:
            is_open, rules = state(at)
            if not is_open or not allowed(rules, at, policy.longest):
                blocked = "robots_disallow" if is_open else "robots_unavailable"
                break
            response = responses.get(at, (404, None, None, ""))
            if response[0] not in crawl.MOVED:
                break
            if not (response[1] or "").strip():
                blocked = "redirect_without_location"
                break
            target = crawl.resolve(at, response[1])
            if not inside(target, domain):
                blocked = "redirect_outside_registrable_domain"
                break
            hops, total = hops + 1, total + 1
            if hops > policy.max_redirects or total > policy.max_redirects_total:
                blocked = "redirect_limit"
                break
            at = target
            chain.append(at)
        attempted += 1
        refused = (blocked or "").startswith("robots")
        status, body = (None, "") if refused else (response[0], response[3] or "")
        if not refused:
            if len(body.encode()) > policy.max_bytes:
                blocked = blocked or "response_too_large"
            blocked = blocked or ("network_error" if status is None else "login_or_captcha" if status in (401, 403) else None)
        pages.append((attempted, url, at, depth, status, kind, blocked))
        settle(parent, url, not refused, blocked or (None if status is not None and 200 <= status < 300 else f"http_{status}"))
        if blocked == "robots_unavailable":
            stop = "robots"
            break
        if refused:
            continue
        if status is None or status in (401, 403):
            stop = "network_error" if status is None else "login_or_captcha"
            break
        if blocked or not 200 <= status < 300 or not (response[2] or "").lower().startswith(("text/html", "application/xhtml")):
            continue
        if re.search(crawl.LOGIN, urlsplit(at).path) or re.search(crawl.PERSON, body) or re.search(crawl.PASSWORD, body):
            stop = "login_or_captcha"
            break
        for _, to, k in crawl.links_of(body, at):
            parts = urlsplit(to)
            why = "unsafe_scheme_or_credentials" if parts.scheme not in ("http", "https") or parts.username or parts.password else None if inside(to, domain) else "cross_registrable_domain"
            if why is None and depth >= policy.max_depth:
                why = "depth_limit"
            if why is None:
                why = "already_queued" if to in queued else "pending"
                if why == "pending":
                    queued.add(to)
                    queue.append((to, depth + 1, at, k))
            edges.append({"from": at, "to": to, "kind": k, "followed": False, "reason": why, "deep": depth >= policy.max_depth})
    if stop is None and queue:
        stop = "page_cap"
    for e in edges:
        if stop == "page_cap" and e["reason"] == "pending":
            e["reason"] = "page_cap"
    deep = any(e["deep"] for e in edges)
    return pages, sorted((e["from"], e["to"], e["kind"], e["followed"], str(e["reason"])) for e in edges), attempted, stop or ("depth_limit" if deep else "queue_exhausted")


def compare(found, seeds, responses, policy):
    held = {u: (s, loc, t, b) for u, s, loc, t, b in responses}
    pages, edges, sites = {}, {}, {x.site: (x.attempted, x.stop_reason) for x in found.sites.collect()}
    for x in found.pages.collect():
        pages.setdefault(x.site, []).append((x.place, x.url, x.final_url, x.depth, x.status, x.kind, x.blocked))
    for x in found.edges.collect():
        edges.setdefault(x.site, []).append((x.from_url, x.to_url, x.kind, x.followed, str(x.reason)))
    for site, url, domain in seeds:
        want = brute(url, domain, held, policy)
        assert sorted(pages.get(site, [])) == want[0], site
        assert sorted(edges.get(site, [])) == want[1], site
        assert sites[site] == want[2:], site


@pytest.mark.parametrize("policy", [Policy(max_depth=3, page_cap=20), Policy(max_depth=1, page_cap=4, longest=False), Policy(max_depth=4, page_cap=50, max_redirects_total=2)])
def test_pages(spark, sf, policy):
    from lakewright.plans.written import written

    table = written(crawl.page_responses(spark, sf))
    seeds = written(crawl.page_seeds(table))
    compare(crawl.crawl(seeds, table, policy), [tuple(x) for x in seeds.collect()], [tuple(x) for x in table.collect()], policy)


def page(*links, extra=""):
    return "".join(f'<a href="{to}">x</a>' for to in links) + extra


SITE = [
    ("https://a.org/", 200, None, "text/html", page("/r1", "/far", "/loop", "/none", "/big", "/b", "/q?x=1", extra='<form><a href="/inside">f</a></form><area href="/map"><a rel="next" href="/n">n</a><a href="/search/x">s</a><a download href="/d">d</a><a href="javascript:x()">j</a><a href="http://u:p@a.org/">c</a><a href="http://[bad">e</a>')),
    ("https://a.org/r1", 301, "/r2", None, None), ("https://a.org/r2", 308, "https://www.a.org/end#x", None, None), ("https://www.a.org/end", 200, None, "text/html", page("/deep", "../")), ("https://a.org/far", 302, "https://b.org/", None, None),
    ("https://a.org/loop", 302, "/loop", None, None), ("https://a.org/none", 302, " ", None, None), ("https://a.org/big", 200, None, "text/html", "é" * 600), ("https://a.org/b", 200, None, "application/pdf", page("/never")), ("https://a.org/q?x=1", 200, None, "TEXT/HTML", page("/deep2")),
    ("https://a.org/n", 500, None, "text/html", page("/never")), ("https://www.a.org/deep", 200, None, "text/html", page("/deeper")), ("https://a.org/map", 200, None, "text/html", '<input name=x type="password">'), ("https://a.org/deep2", 200, None, "text/html", page("/x")),
    ("https://www.a.org/robots.txt", 200, None, "text/plain", "User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /d*p$\nAllow: /deep\n"),
    ("https://c.org/", 200, None, "text/html", page("/1", "/2", "/3")), ("https://c.org/1", None, None, None, None), ("https://c.org/2", 200, None, "text/html", ""), ("https://d.org/robots.txt", 503, None, None, None), ("https://d.org/", 200, None, "text/html", page("/1")),
    ("https://e.org/", 200, None, "text/html", page("/login/")), ("https://e.org/login/", 200, None, "text/html", page("/1")), ("https://f.org/", 200, None, "text/html", page("/1", "/2", "/1")), ("https://f.org/1", 200, None, "text/html", page("/2", "/")), ("https://f.org/2", 200, None, "text/html", ""),
]


@pytest.mark.parametrize("policy", [Policy(max_bytes=1024), Policy(max_bytes=1024, max_depth=5, page_cap=9, longest=False), Policy(max_redirects=1), Policy(max_depth=0)])
def test_small_sites(spark, policy):
    seeds = [(f"{h}", f"https://{h}.org/", f"{h}.org") for h in "acdefg"] + [("x", "https://a.org/", "other.org")]
    found = crawl.crawl(spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(SITE, RESPONSES).repartition(3), policy)
    assert "x" not in {s.site for s in found.sites.collect()}
    compare(found, seeds[:-1], SITE, policy)


def test_robots_rules():
    text = "User-agent: LakewrightSpider\nUser-agent: b\nDisallow: /x # why\nAllow: /x/y\nDisallow:\n\nUser-agent: *\nDisallow: /\n"
    assert crawl.robots_rules(text, "LakewrightSpider") == [(False, "^/x"), (True, "^/x/y")]
    assert crawl.robots_rules(text, "z") == [(False, "^/")] and crawl.robots_rules("Disallow: /a", "z") == []


def test_no_seeds(spark):
    found = crawl.crawl(spark.createDataFrame([], SEEDS), spark.createDataFrame(SITE, RESPONSES))
    assert found.pages.count() == found.edges.count() == found.sites.count() == 0
