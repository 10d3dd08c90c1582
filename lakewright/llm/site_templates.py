"""HTML extraction with removal of site templates.

Pages are parsed by a small tolerant tokenizer into a tree.  Every element's subtree has two hashes: of its form (the tags,
classes, ids and roles from the page's root down to it, long numbers masked), and of its tags and texts.  Spark counts both per host.
Of a host of MIN_PAGES pages or more these subtrees are templates and are deleted from its pages:

* a form on many of its pages that holds links for the most part, or a small part of those pages' text (menus, banners, notices,
  adverts, footers, whatever they are called and though their words change from page to page);
* a subtree that recurs word for word on most of its pages, beside different contents.

A page's content is protected: its article and main elements, or else the smallest element that holds most of its text
outside of links and templates.  Forms are not deleted inside of it, nor is anything that encloses it.  Copies of one article are
one content, so no article is a template because it is copied.

Names back the counts up: elements that by tag, role or class are menus, headers, footers, sidebars, notices, adverts, forms or comments are left out
too, and on hosts of few pages they alone decide; there, where a page has article or main elements, only these count.  A name counts as a menu
(and so on) by its last word, 'site-nav' but not 'has-nav' or 'share-page', and never hides a page's main element or its only articles.
"""

from __future__ import annotations

import functools
import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import materialise, small

#: A host of fewer pages is not judged by counts.
MIN_PAGES = 3
#: A form is a template if it is on such a share of its host's pages and holds at least LINKS of its text in links or at most SMALL of the pages' text.
FORM_SHARE, LINKS, SMALL = 0.1, 0.5, 0.25
#: A text is a template if it is on so many pages of its host and such a share of them, at least half of them of different contents.
TEXT_PAGES, TEXT_SHARE = 10, 0.5
#: A subtree of more than half of its page's text is a template only if it is so short: longer ones are taken for contents.
SHORT = 100
#: Elements of running text, never a template by their form where the page itself is the content.
PLAIN = frozenset("a b blockquote cite code dd dl dt em font h1 h2 h3 h4 h5 h6 i li ol p pre q s small span strong sub sup table tbody td th tr u ul".split())
#: Copies of a host's templates where they are too many to be broadcast, so that its pages are not one task's.
SALTS = 32

#: HTML's void elements, raw-text elements, and elements that begin a text block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
INVISIBLE = frozenset("head iframe noembed noframes noscript script style template title".split())
#: Elements that a form holds only if it is wrapped around a page.
STRUCTURE = frozenset("article footer header main nav".split())
DROPPED = frozenset("""aside audio button canvas datalist dialog footer form head header iframe map menu meter nav noembed noframes noscript object optgroup option
output progress script select style svg template textarea title video""".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset("""ad ads adsbygoogle adv advert advertisement advertising adsense alert alerts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead
menu menubar modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion related replies reply respond share sharing sidebar
sidenav signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets""".split())
#: Words of a name that only says whether an element has such a part.
MODIFIERS = frozenset("has have no not with without".split())
#: What an opening tag closes implicitly, up to the nearest of the barriers.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)", re.S)
_MAIN = re.compile(r"""(?:^|[\s"'])role\s*=\s*(?:"main"|'main'|main(?=[\s/]|$))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class _Node:
    __slots__ = ("chars", "digest", "dropped", "form", "inside", "links", "parts", "tag")

    def __init__(self, tag: str, dropped: int, inside: bool, form: int):
        self.tag, self.dropped, self.inside, self.form, self.parts = tag, dropped, inside, form, []
        self.chars = self.links = self.digest = 0

    def nodes(self) -> list[_Node]:
        return [p for p in self.parts if isinstance(p, _Node)]


def _named(value: str) -> bool:
    """Whether one of the names of a class or id attribute is that of a menu, header, footer and so on."""
    for name in value.split():
        words = re.findall("[a-z]+", name)
        if words and words[-1] in NAMES and MODIFIERS.isdisjoint(words):
            return True
    return False


@functools.lru_cache(1 << 16)
def _form(parent: int, tag: str, attributes: str) -> int:
    """Hash of an element's form: its parent's, its tag and its names, with the numbers of ids and the long numbers of classes masked."""
    names = set()
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        kind = m[1].lower()
        if kind in ("class", "id", "role"):
            number = "[0-9]+" if kind == "id" else "[0-9]{3,}"
            names |= {f"{kind}={re.sub(number, '#', v)}" for v in (m[2] or "").strip("\"'").lower().split()}
    return xxhash.xxh64_intdigest(f"{parent:x}/{tag}.{' '.join(sorted(names))}") >> 1


@functools.lru_cache(1 << 16)
def _unwanted(tag: str, attributes: str) -> int:
    """1 if an element is left out by its tag, role or hidden mark, 2 if only by its class or id, or else 0."""
    if tag in DROPPED:
        return 1
    if tag in ("html", "body", "article", "main") or not attributes:
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return 1
        if name in ("class", "id") and _named(value):
            found = 2
    return found


def parse(text: str) -> _Node:
    """The tree of a page; broken markup never fails: what is not closed ends with its parent or the page."""
    root = _Node("", 0, False, 0)
    stack = [root]
    at = 0
    for m in _TOKEN.finditer(text):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].parts.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].parts.append(html.escape(m[0][9:-3]))
            continue
        tag = m[2].lower()
        if m[1]:
            if any(n.tag == tag for n in reversed(stack)):
                while stack.pop().tag != tag:
                    pass
            elif tag == "br":
                stack[-1].parts.append(" ")
            continue
        if tag in VOID:
            stack[-1].parts.append(" " if tag in ("br", "hr") else "")
            continue
        if tag in BLOCK:
            _close(stack, {"p"}, {"button", "td", "th", "caption", "object"})
        if tag in CLOSES:
            _close(stack, CLOSES[tag], BARRIERS[tag])
        node = _Node(tag, _unwanted(tag, m[3]), tag in ("article", "main") or _MAIN.search(m[3]) is not None, _form(stack[-1].form, tag, m[3]))
        if tag in STRUCTURE:
            for outer in stack:
                if outer.tag == "form":
                    outer.dropped = 0  # wrapped around the page
        stack[-1].parts.append(node)
        if tag in RAW:
            skip = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(text, at)
            node.parts.append(text[at : skip.start()])
            at = skip.end()
        elif not m[3].endswith("/") or tag in BLOCK:
            stack.append(node)
    if at < len(text):
        stack[-1].parts.append(text[at:])
    return root


def _close(stack: list[_Node], tags: set[str], barriers: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in barriers or stack[k].tag in ("article", "main", "body", "div", "section"):
            return


def measure(root: _Node) -> list[_Node]:
    """The visible nodes, parents first, with chars (of text), links (of them in links) and digest (of tags and texts) set.  Deep nesting is no recursion."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag not in INVISIBLE:
            nodes.append(node)
            todo += node.nodes()
    inner: dict[int, str] = {}
    for node in reversed(nodes):
        texts = []
        node.chars = node.links = 0
        for p in node.parts:
            if isinstance(p, str):
                if words := p.split():
                    text = " ".join(words)
                    node.chars += len(text)
                    texts.append(text)
            elif id(p) in inner:
                node.chars += p.chars
                node.links += p.links
                texts.append(inner.pop(id(p)))
        if node.tag == "a":
            node.links = node.chars
        whole = " ".join(texts)
        node.digest = xxhash.xxh64_intdigest(whole) >> 1
        inner[id(node)] = f"<{node.tag}>{node.digest:x}" if len(whole) > 200 else f"<{node.tag}>{whole}</>"
    return nodes


def content(root: _Node, forms: frozenset[int] = frozenset(), texts: frozenset[int] = frozenset()) -> list[_Node]:
    """A measured page's content: its article and main elements, or the smallest element with most of the text outside of links, names and template forms."""
    chosen, hidden = _articles(root, set())
    if chosen or hidden:
        return chosen or hidden
    node = root
    while True:
        own = {id(p): p.chars - p.links for p in node.nodes() if p.tag not in INVISIBLE and not p.dropped and p.form not in forms and p.digest not in texts}
        best = max((p for p in node.nodes() if id(p) in own), key=lambda p: own[id(p)], default=None)
        if best is None or best.tag in PLAIN or 2 * own[id(best)] <= sum(own.values()) + sum(len(p) for p in node.parts if isinstance(p, str)):
            return [node]
        node = best


def main_text(root: _Node) -> str:
    """The blocks of the page's main text by tags and names alone, one a line."""
    chosen, hidden = _articles(root, set())
    return _text(chosen or [root], set()) or _text(hidden, set())


def main_text_by_counts(root: _Node, forms: frozenset[int], texts: frozenset[int], names: bool = True) -> tuple[str, int, int]:
    """The page's text without its host's templates and, if names, without what names leave out; how many subtrees went by counts and by names."""
    nodes = measure(root)
    held = content(root, forms, texts)
    open_ = all(n.tag in ("", "html", "body") for n in held)
    kept = {id(n) for n in held}
    parent = {id(p): n for n in nodes for p in n.nodes()}
    above = set(kept)
    for n in nodes:
        if id(n) in kept:
            while id(n) in parent and id(parent[id(n)]) not in above:
                n = parent[id(n)]
                above.add(id(n))
    gone: set[int] = set()
    counted = named = 0
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        within = within or (id(node) in kept and not open_) or (open_ and node.tag in PLAIN)
        if id(node) not in above and node.chars:
            if (not within and node.form in forms) or node.digest in texts:
                counted += 1
                gone.add(id(node))
                continue
            if names and node.dropped:
                named += 1
                gone.add(id(node))
                continue
        todo += [(p, within) for p in node.nodes() if p.tag not in INVISIBLE]
    text = _text([root], gone, names, above)
    if text:
        return text, counted, named
    return main_text_by_counts(root, frozenset(), texts, names) if forms else (main_text(root), 0, named)


def _text(tops: list[_Node], gone: set[int], names: bool = True, above: set[int] | frozenset = frozenset()) -> str:
    blocks: list[str] = []
    for top in tops:
        pending: list[str] = []
        todo: list = [top]
        while todo:
            part = todo.pop()
            if part is None:
                _flush(pending, blocks)
            elif isinstance(part, str):
                pending.append(part)
            elif (not part.dropped or part is top or id(part) in above or (not names and part.tag not in INVISIBLE)) and id(part) not in gone:
                block = part.tag in BLOCK
                if block:
                    _flush(pending, blocks)
                    todo.append(None)
                todo += reversed(part.parts)
        _flush(pending, blocks)
    return "\n".join(blocks)


def _flush(pending: list[str], blocks: list[str]) -> None:
    if pending and (words := html.unescape("".join(pending)).split()):
        blocks.append(" ".join(words))
    pending.clear()


def _articles(root: _Node, gone: set[int]) -> tuple[list[_Node], list[_Node]]:
    """The outermost article and main elements in their order, and apart the articles within elements that their class or id leaves out."""
    chosen: list[_Node] = []
    hidden: list[_Node] = []
    todo = [(root, False)]
    while todo:
        node, named = todo.pop()
        if node.dropped == 1 or id(node) in gone:
            continue
        if node.inside:
            (hidden if named and node.tag == "article" else chosen).append(node)
            continue
        named = named or node.dropped == 2
        todo += [(p, named) for p in reversed(node.parts) if isinstance(p, _Node)]
    return chosen, hidden


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _counts(pages: DataFrame) -> DataFrame:
    """(host, kind, key, pages, chars, links, whole, contents) of every host: kind 0 its pages, 1 its forms, 2 its texts.

    A page counts once for each key.  chars and links are those of the key's subtrees, whole those of the pages that have it, contents about
    how many different contents those pages have (a sketch of fixed size).  Everything is summed up before and after one shuffle by key.
    """

    def run(batches):
        names = ["host", "kind", "key", "pages", "chars", "links", "whole", "content"]
        kinds = (pa.string(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                sums: dict[tuple, list[int]] = {}
                rows: list[tuple] = []
                for host, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    root = parse(text or "")
                    nodes = measure(root)
                    own: dict[tuple, list[int]] = {(host, 0, 0): [0, 0]}
                    alike = content(root)
                    shown = xxhash.xxh64_intdigest(" ".join(f"{n.digest:x}" for n in alike)) >> 1
                    seen = set()
                    for node in nodes:
                        if not node.chars or node.tag in ("", "html", "body"):
                            continue
                        if node.tag not in ("article", "main"):
                            total = own.setdefault((host, 1, node.form), [0, 0])
                            total[0] += node.chars
                            total[1] += node.links
                        if (2 * node.chars <= root.chars or node.chars <= SHORT) and node.digest not in seen:
                            seen.add(node.digest)
                            rows.append((host, 2, node.digest, 1, node.chars, node.links, root.chars, shown if 2 * node.chars <= root.chars else root.digest))
                    for key, (chars, links) in own.items():
                        total = sums.setdefault(key, [0, 0, 0, 0])
                        for i, x in enumerate((1, chars, links, root.chars)):
                            total[i] += x
                rows += [(*key, *total, None) for key, total in sums.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    found = pages.select(_host().alias("host"), "html").mapInArrow(run, "host string, kind byte, key long, pages long, chars long, links long, whole long, content long")
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "links", "whole")]
    return found.groupBy("host", "kind", "key").agg(*sums, F.approx_count_distinct("content", 0.2).alias("contents"))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, form_share: float = FORM_SHARE, text_pages: int = TEXT_PAGES, text_share: float = TEXT_SHARE) -> DataFrame:
    """(host, forms, texts) of the hosts with at least min_pages pages: the hashes of their templates' forms and texts.

    There are at most 1 / form_share times as many per host as a page has elements.
    """
    often = materialise(_counts(pages).where(F.col("pages") >= min_pages))
    totals = often.where("kind = 0").select("host", F.col("pages").alias("all"))
    form = (F.col("kind") == 1) & (F.col("pages") >= F.col("all") * form_share) & ((F.col("links") >= F.col("chars") * LINKS) | (F.col("chars") <= F.col("whole") * SMALL))
    text = (F.col("kind") == 2) & (F.col("pages") >= text_pages) & (F.col("pages") >= F.col("all") * text_share) & (2 * F.col("contents") >= F.col("pages"))
    known = often.join(totals, "host")
    return known.groupBy("host").agg(F.collect_list(F.when(form, F.col("key"))).alias("forms"), F.collect_list(F.when(text, F.col("key"))).alias("texts"))


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, names: bool = True, **thresholds) -> DataFrame:
    """(page_id, url, text, n_chars, n_by_counts, n_by_names) for every row of pages(page_id, url, html).

    The last two say how many subtrees went as their host's templates and by their names; null where the host has too few pages for counts.
    Null pages are empty and give an empty text; pages without a host are the pages of one host, "".  Repeated rows
    are pages of their own.  Broken markup, unknown elements and very deep nesting give whatever text they hold.  Other columns are not read.
    """
    found = materialise(site_templates(pages, min_pages, **thresholds))
    known = pages.select("page_id", "url", "html", _host().alias("host"))
    if (ready := small(found, "1 + size(forms) + size(texts)")) is not found:
        joined = known.join(ready, "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = known.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                rows = []
                for page, forms, texts in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    root = parse(page or "")
                    rows.append((main_text(root), None, None) if forms is None else main_text_by_counts(root, frozenset(forms), frozenset(texts), names))
                columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["page_id", "url", "text", "n_chars", "n_by_counts", "n_by_names"])

    return joined.select("page_id", "url", "html", "forms", "texts").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_by_counts int, n_by_names int")
