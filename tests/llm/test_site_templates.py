"""Site templates by counts: planted boilerplate under meaningless names, copies, wrappers, and a brute-force count."""

import random
from collections import Counter, defaultdict

import pytest

from lakewright.llm import site_templates as st

PAGES = "page_id long, url string, html string"


def prose(r, n):
    return " ".join("".join(r.choice("aeiou") + r.choice("bcdfglmnprst") for _ in range(r.randrange(1, 5))) for _ in range(n))


def site(r, host, n, first):
    """n pages without a telling name or tag; menus, banners and footers whose words change from page to page."""
    rows, texts = [], {}
    for i in range(first, first + n):
        story = [prose(r, r.randrange(20, 80)) for _ in range(r.randrange(2, 6))]
        links = "".join(f"<span class=k1><a href='/{i}'>{prose(r, 1)}</a></span>" for _ in range(8))
        html = f"<body><div class=q1>{links}</div><div class=q2 id=z{i}>{prose(r, 6)}</div><div class=q3>" + "".join(f"<p>{p}</p>" for p in story) + f"</div><div class=q4>{prose(r, 9)}</div></body>"
        rows.append((i, f"https://{host}/{i}", html))
        texts[i] = "\n".join(story)
    return rows, texts


def test_planted_boilerplate_goes_and_stories_stay(spark):
    r = random.Random(1)
    rows, texts = [], {}
    for k, n in enumerate((3, 5, 12, 60)):
        more, own = site(r, f"h{k}.x", n, 1000 * k)
        rows += more
        texts |= own
    got = {x.page_id: x for x in st.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert sum(got[i].text == t for i, t in texts.items()) >= 0.95 * len(texts)
    assert all(set(t.split("\n")) <= set(got[i].text.split("\n")) for i, t in texts.items())
    off = {x.page_id: x.text for x in st.extracted(spark.createDataFrame(rows, PAGES), form_share=2.0, text_share=2.0).collect()}
    assert not any(off[i] == t for i, t in texts.items())


def test_copies_of_an_article_are_no_template(spark):
    r = random.Random(2)
    story = "<div class=s>" + "".join(f"<p>{prose(r, 40)}</p>" for _ in range(4)) + "</div>"
    rows = [(i, f"http://a.x/{i}", f"<body><nav><a href=/>{prose(r, 2)}</a></nav>{story}") for i in range(40)]
    got = {x.text for x in st.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == 1 and len(got.pop().split("\n")) == 4


def test_a_recurring_box_inside_articles_goes(spark):
    r = random.Random(3)
    rows = [(i, f"http://a.x/{i}", f"<article><p>{prose(r, 30)}</p><p>Write to us every day</p></article>") for i in range(30)]
    assert not any("Write to us" in x.text for x in st.extracted(spark.createDataFrame(rows, PAGES)).collect())


@pytest.mark.parametrize("wrap", ["<form>{}</form>", "<div class=social-science>{}</div>", "<div class='widget'>{}</div>", "<header>{}</header>" * 0 + "<form><div>{}</div></form>"])
def test_wrapped_articles_are_not_lost(spark, wrap):
    r = random.Random(4)
    stories = {i: prose(r, 30) for i in range(6)}
    rows = [(i, f"http://{'a.x' if i < 5 else 'b.x'}/{i}", "<body>" + wrap.format(f"<article><p>{t}</p></article>")) for i, t in stories.items()]
    assert {x.page_id: x.text for x in st.extracted(spark.createDataFrame(rows, PAGES)).collect()} == stories


def test_counts_against_brute_force(spark):
    r = random.Random(5)
    rows = site(r, "a.x", 15, 0)[0] + site(r, "b.x", 4, 100)[0] + [(900, None, None), (901, "http://c.x", ""), (901, "http://c.x", "")]
    forms, pages = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for _, url, html in rows:
        host = url.split("/")[2] if url else ""
        pages[host] += 1
        root = st.parse(html or "")
        own = defaultdict(lambda: [0, 0])
        for node in st.measure(root):
            if node.chars and node.tag not in ("", "html", "body", "article", "main"):
                own[node.form][0] += node.chars
                own[node.form][1] += node.links
        for form, (chars, links) in own.items():
            total = forms[host, form]
            for i, x in enumerate((1, chars, links, root.chars)):
                total[i] += x
    want = defaultdict(set)
    for (host, form), (n, chars, links, whole) in forms.items():
        if n >= 3 and pages[host] >= 3 and n >= 0.1 * pages[host] and (2 * links >= chars or 4 * chars <= whole):
            want[host].add(form)
    got = {x.host: set(x.forms) for x in st.site_templates(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == dict(want) and got
