"""Nodes of pages: listings on planted pages, selectors against a search of the tree, records of XML."""

import random
from xml.etree import ElementTree

import pytest

from lakewright.functions import page_nodes, xml_records


def pages(spark, *html):
    return page_nodes.nodes(spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))


def listed(spark, *html, **options):
    rows = page_nodes.listings(pages(spark, *html), **options).collect()
    return [(r.page_id, r.record, r.title, r.link, *r.fields) for r in sorted(rows, key=lambda r: (r.page_id, r.record))]


def card(n, extra=""):
    return f'<div class="b a"><h3><a href="/{n}">Shop {n}</a></h3><p>Address</p><p>Road\n {n}</p>{extra}</div>'


def test_nodes_of_broken_markup(spark):
    rows = pages(spark, '<ul><li>a<li>b &amp; c</ul></b><script>x<p></script><br>t<!-- no -->u', None, "").collect()
    assert {r.page_id for r in rows} == {0}
    assert [(r.tag, r.text, r.node, r.last, r.parent, r.place, r.siblings) for r in sorted(rows, key=lambda r: r.node) if r.tag not in ("script", "br")] == [
        ("ul", None, 0, 4, -1, 1, 3), ("li", None, 1, 4, 0, 1, 1), ("#text", "a", 2, 2, 1, None, 1), ("li", None, 3, 4, 1, 1, 1), ("#text", "b & c", 4, 4, 3, None, 0), ("#text", "t", 7, 7, -1, None, 3), ("#text", "u", 8, 8, -1, None, 3),
    ]


def test_listing_with_titles_links_and_labels(spark):
    menu = "".join(f'<li class="m"><a href="/{k}">{k}</a></li>' for k in range(9))
    html = f"<ul>{menu}</ul>" + card(1) + card(2) + card(3, "<p>Closed</p>")
    assert listed(spark, html) == [(0, n, f"Shop {n}", f"/{n}", f"Shop {n}", "Address", f"Road {n}", *(["Closed"] if n == 3 else [])) for n in (1, 2, 3)]
    labels = page_nodes.listing_labels(page_nodes.listings(pages(spark, html))).collect()
    assert [r.labels for r in labels] == [["record title", "record link", "Address"]]


def test_a_menu_is_no_listing(spark):
    card = "<div class='card'><b>t</b><i>u</i><u>v</u></div>"
    page = "<ul><li class=n>one</li><li class=n>two</li><li class=n>three</li></ul>" + card * 3
    assert listed(spark, page) == [(0, n, "", "", "t", "u", "v") for n in (1, 2, 3)]


def test_members_inside_members_and_short_members(spark):
    # the inner block is no record of its own, so two are left and the group is no listing
    nested = card(1, card(9)) + card(2)
    assert listed(spark, nested) == []
    assert [r[1:5] for r in listed(spark, nested + card(3))] == [(1, "Shop 1", "/1", "Shop 1"), (2, "Shop 2", "/2", "Shop 2"), (3, "Shop 3", "/3", "Shop 3")]
    # one short member ends a group, whatever the others hold
    assert listed(spark, card(1) + card(2) + card(3) + '<div class="a b">x</div>') == []
    assert listed(spark, card(1) + card(2), None, "") == []
    # the richer group wins; of equal ones the first
    equal = "".join(f'<p class="{c}"><b>{c}</b><b>{n}</b><b>x</b></p>' for n in range(3) for c in "qp")
    assert [r[4] for r in listed(spark, equal)] == ["q"] * 3
    # records that are links themselves have no title of their own
    assert [r[2:4] for r in listed(spark, '<a class="x" href="/1"><b>1</b><b>2</b><b>3</b></a>' * 3)] == [("", "")] * 3
    assert [len(r) - 4 for r in listed(spark, ('<p class="x">' + "<b>1</b>" * 50 + "</p>") * 3)] == [40] * 3


def random_tree(r, depth=0):
    tag = r.choice("abc")
    attrs = (f' class="{r.choice(["x", "y", "x y"])}"' if r.random() < 0.5 else "") + (f' data-k="{r.choice(["one", "two-1", ""])}"' if r.random() < 0.3 else "")
    inner = "".join(random_tree(r, depth + 1) if r.random() < 0.7 else r.choice(["t", "u v"]) for _ in range(r.randrange(4))) if depth < 6 else "leaf"
    return f"<{tag}{attrs}>{inner}</{tag}>"


def brute(html, steps):
    """Numbers of the elements that steps [(way, test(element, place))] pick, by trying every one."""
    root = ElementTree.fromstring(html)
    order = list(root.iter())
    above = {c: p for p in order for c in p}

    def picks(e, k):
        way, test = steps[k]
        family = list(above[e]) if e in above else [root]
        at = family.index(e)
        if not test(e, at + 1, len(family)):
            return False
        if k == 0:
            return True
        up = []
        p = above.get(e)
        while p is not None:
            up.append(p)
            p = above.get(p)
        return any(picks(c, k - 1) for c in {" ": up, ">": up[:1], "+": family[:at][-1:], "~": family[:at]}[way])

    return [i for i, e in enumerate(order) if picks(e, len(steps) - 1)]


def has(e, c):
    return c in (e.get("class") or "").split()


SELECTORS = {
    "a b": [("", lambda e, *_: e.tag == "a"), (" ", lambda e, *_: e.tag == "b")],
    "a > b": [("", lambda e, *_: e.tag == "a"), (">", lambda e, *_: e.tag == "b")],
    ".x>b c": [("", lambda e, *_: has(e, "x")), (">", lambda e, *_: e.tag == "b"), (" ", lambda e, *_: e.tag == "c")],
    "a + b.y": [("", lambda e, *_: e.tag == "a"), ("+", lambda e, *_: e.tag == "b" and has(e, "y"))],
    "a ~ c": [("", lambda e, *_: e.tag == "a"), ("~", lambda e, *_: e.tag == "c")],
    "a * > :first-child": [("", lambda e, *_: e.tag == "a"), (" ", lambda e, *_: True), (">", lambda e, at, n: at == 1)],
    "*:last-child:nth-child(2)": [("", lambda e, at, n: at == n == 2)],
    "[data-k]": [("", lambda e, *_: e.get("data-k") is not None)],
    '[data-k|="two"]': [("", lambda e, *_: e.get("data-k") == "two-1")],
    "b[data-k^='o'] ~ *": [("", lambda e, *_: e.tag == "b" and e.get("data-k") == "one"), ("~", lambda e, *_: True)],
    '[data-k*=""]': [("", lambda e, *_: False)],
}


def test_selectors_against_a_search(spark):
    r = random.Random(3)
    made = [f"<b>{''.join(random_tree(r) for _ in range(3))}</b>" for _ in range(25)]
    found = pages(spark, *made).cache()
    order = {}
    for row in sorted(found.where("tag <> '#text'").collect(), key=lambda x: (x.page_id, x.node)):
        order.setdefault(row.page_id, []).append(row.node)
    for selector, steps in SELECTORS.items():
        got = {(x.page_id, x.node) for x in page_nodes.selected(found, selector).collect()}
        assert got == {(p, order[p][i]) for p, html in enumerate(made) for i in brute(html, steps)}, selector
    both = page_nodes.selected(found, "a b, b").collect()
    assert len(both) == len({(x.page_id, x.node) for x in both}) == sum(1 for html in made for e in ElementTree.fromstring(html).iter("b"))
    for x in both[:50]:
        e = list(ElementTree.fromstring(made[x.page_id]).iter())[order[x.page_id].index(x.node)]
        assert x.text.split() == " ".join(t for t in e.itertext() if t.strip()).split()
    found.unpersist()


@pytest.mark.parametrize("selector", ["", "a >", "> a", "a:hover", "a[", "a,,b", "a > > b"])
def test_selectors_that_are_none(spark, selector):
    with pytest.raises(ValueError, match="not a selector"):
        page_nodes.selected(pages(spark, "<a></a>"), selector)


def test_records_of_xml(spark):
    text = "<r><a> 1 </a><n><x>p<i>q</i> s </x><y/></n><a>2</a></r>"
    outer, inner = {"a": "2", "n": "pqs"}, {"x": "pqs", "y": ""}
    assert xml_records.leaf_records(text) == [(1, outer), (2, {"i": "q"}), (3, inner), (4, outer)]
    assert xml_records.leaf_records(b"<t>alone</t>") == [(1, {"t": "alone"})]
    assert xml_records.leaf_records("<t><!-- c --><a>x <!-- c --> y</a></t>") == [(1, {"a": "xy"})]
    rows = xml_records.xml_records(spark.createDataFrame([(1, text), (2, "<a>"), (3, None), (4, "")], "doc_id long, content string")).collect()
    assert [(r.doc_id, r.leaf) for r in rows] == [(1, 1), (1, 2), (1, 3), (1, 4), (2, None)]
    assert rows[-1].error and dict(zip(rows[0].names, rows[0].texts, strict=True)) == outer
