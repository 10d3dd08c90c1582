"""The training-data operators against their plain Python versions, on small and odd tables."""

import random
import re

import brute
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakewright.llm import chat_format, decontamination, mixing, ngram_jaccard, secret_scan, site_templates, spot_signatures, substring_dedup, token_binary, toxicity
from lakewright.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words(n, seed, stock=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(stock)}" for _ in range(n))


BASE = words(300, 1)
PASSAGE = words(60, 2)


def near(text, seed, changes):
    r, parts = random.Random(seed), text.split()
    for _ in range(changes):
        parts[r.randrange(len(parts))] = f"x{r.randrange(10**6)}"
    return " ".join(parts)


TEXTS = [
    "", None, " \t\n", "one", "Two words", "a b c d", BASE, BASE, BASE.upper(), near(BASE, 3, 4), near(BASE, 4, 9), near(BASE, 5, 40), f"start {PASSAGE} end", f"{words(80, 6)} {PASSAGE}",
    f"{PASSAGE} {words(50, 7)} {PASSAGE}", "é ü ß 中文 слово " * 30, "the of and the of and", "de la les un une des " * 2000, words(30000, 8), "password = \"hunter2hunter2\" tail", "token=ab secret: token: abcdefgh",
    "x AKIA" + "Q7" * 9 + " y " + "0123456789abcdef" * 3, "\x01\x02 secret='aaaaaaaa'\x01", "z" * 100_000, "<|endoftext|> a b　 c  d\n\n\ne ", PASSAGE,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts under ascending ids, with columns whose names operators use themselves."""
    rows = [(i * 3, t, "en", None if i % 7 == 3 else f"s{i % 4}", 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS score", "1 AS size", "2 AS copies", "'k' AS key", "0 AS n_words", "'m' AS mark", "'p' AS part", "'i' AS items", "'r' AS signatures")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def repeated(spark):
    """A doc_id twice with one text, another with two texts, and rows without an id."""
    rows = [(1, BASE, "en", "a", 1), (1, BASE, "en", "a", 1), (2, PASSAGE, "en", "a", 1), (2, BASE, "en", "b", 1), (None, BASE, "en", "a", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


PAIRS = [(i * 3, t) for i, t in enumerate(TEXTS)]


def rows(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


def test_mixing(spark, docs, empty, repeated):
    found = mixing.mixed_sizes(docs).collect()
    sources = {i * 3: None if i % 7 == 3 else f"s{i % 4}" for i in range(len(TEXTS))}
    wanted = brute.targets([(i, sources[i], t) for i, t in PAIRS])
    for r in found:
        size, target = wanted[sources[r.doc_id]]
        assert r.source_size == size and r.target == pytest.approx(target)
        assert r.taken <= 3 * r.size and r.taken in [k * r.size for k in range(4)]
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mixed_sizes(docs).collect()))
    assert mixing.mixed_sizes(empty).count() == 0
    assert mixing.mixed_sizes(repeated).count() == 6
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in out.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    sized = {r.doc_id: r for r in found if r.size}
    assert all(taken.get(i, 0) * r.size == r.taken for i, r in sized.items())


def test_mixing_comes_near_its_targets(spark):
    r = random.Random(0)
    many = spark.createDataFrame([(i, "w " * r.randrange(1, 200), "en", f"s{i % 3}", 1) for i in range(3000)], DOCS)
    sums = {}
    for x in mixing.mixed_sizes(many).collect():
        sums.setdefault(x.target, [0])[0] += x.taken
    assert all(abs(taken - target) <= 0.005 * target for target, (taken,) in sums.items())


def test_decontamination(spark, docs, empty, repeated):
    items = [(1, PASSAGE), (2, PASSAGE), (3, "Two words"), (4, ""), (5, None), (None, "a b c d"), (6, "nothing like it is anywhere in these documents at all, no"), (10, " ".join(BASE.split()[5:17]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(PAIRS, [(i, t) for i, t in items if i is not None])
    for block in (decontamination.BLOCK_BYTES, 200):  # in one block and in several
        spans = decontamination.removal_spans(docs.select("doc_id", "text"), bench, block_bytes=block)
        got = {r.doc_id: (r.n_words, sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])), len(r["items"])) for r in spans.collect()}
        for i, (n, hit, n_items, _) in want.items():
            if TEXTS[i // 3] != "a b c d":  # the item without an id hits it, and is not listed
                assert got[i] == (n, hit, n_items), i
        assert got[15] == (4, 4, 0)
    assert rows(decontamination.contamination(docs, bench), "items_sha256", "contaminated")[75] == (want[75][3], True)
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[1] and i != 15}
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(repeated, bench).count() == 6
    assert decontamination.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_fm_index_finds_all():
    import numpy as np

    r = np.random.default_rng(0)
    text = r.integers(1, 4, 500)
    index = decontamination.FMIndex(text)
    phrases = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)])
    row, low, high = index.search(phrases)
    for k, a, b in zip(row, low, high, strict=True):
        want = [i for i in range(len(text) - 2) if (text[i : i + 3] == phrases[k]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_secrets(spark, docs, empty, repeated):
    got = {r.doc_id: r for r in secret_scan.secrets(docs).collect()}
    for i, text in PAIRS:
        want = brute.secrets(text)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == want[:4], i
        assert set(want[4]) <= set(filter(None, got[i].spans.split(",")))
    assert secret_scan.secrets(empty).count() == 0 and secret_scan.secrets(repeated).count() == 6


def test_randomness_battery_adds_random_tokens_only(spark):
    r = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["the", "tion", "er", "an", "in", "ou", "re", "ea"]
    plain = ["".join(r.choice(syllables) for _ in range(12)) for _ in range(400)]
    secret = "".join(r.choice(letters) for _ in range(40))
    texts = [(i, w, "en", "a", 1) for i, w in enumerate(plain)] + [(1000, f"x {secret} y", "en", "a", 1), (1001, "a-b-" * 12, "en", "a", 1)]
    got = {x.doc_id: x.spans for x in secret_scan.secrets(spark.createDataFrame(texts, DOCS)).collect()}
    assert got[1000] == "random:2:42" and sum(bool(v) for v in got.values()) == 1


def test_a_lone_random_key_needs_no_other_tokens(spark):
    r = random.Random(11)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    prose = "There would be another question about which state-of-the-art-programs to build, see /docs/getting-started/installation for information "
    for n in (32, 40, 44, 64):
        keys = [key(n) for _ in range(20)]
        texts = [(i, prose * 3 + f" {k} " + prose, "en", "a", 1) for i, k in enumerate(keys)]
        assert [n for x in secret_scan.secrets(spark.createDataFrame(texts[:1], DOCS)).collect() for n in x.spans.split(",")] == [f"random:{len(prose) * 3 + 1}:{len(prose) * 3 + 1 + n}"]
        got = [x.spans for x in secret_scan.secrets(spark.createDataFrame(texts, DOCS)).collect()]
        assert sum(bool(x) for x in got) >= 18 and max(x.count("random") for x in got) == 1


def test_long_prose_tokens_are_not_random(spark):
    r = random.Random(12)
    stock = "the time people would there their about which because government information development between important service number through nothing program question without another problem public system report".split()
    texts = [(i, r.choice(("-", "_", "/")).join(r.choice(stock) for _ in range(r.randrange(4, 9))), "en", "a", 1) for i in range(400)]
    assert sum(bool(x.spans) for x in secret_scan.secrets(spark.createDataFrame(texts, DOCS)).collect()) <= 2


def test_substring_dedup(spark, docs, empty, repeated):
    assert rows(substring_dedup.substring_dedup_digests(docs), "n_words", "n_removed", "kept_sha256") == brute.kept([(i, t or "") for i, t in PAIRS])
    assert substring_dedup.substring_dedup(empty).count() == 0
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(repeated).collect())
    # the row without an id comes first and stays; all other copies go, the passage stays
    assert got == [(False, 0, 0, 0), (False, 0, 300, 0), (True, 1, 300, 300), (True, 1, 300, 300), (True, 2, 60, 0), (True, 2, 300, 300)]


@pytest.mark.parametrize("window", [2, 5, 20, 31])
def test_covers(window):
    period, cover = substring_dedup.cover_for(window)
    assert all(any((i + s) % period in cover and (j + s) % period in cover for s in range(period)) for i in range(period) for j in range(period))


def test_fingerprints(spark, docs, empty, repeated):
    got = {r.doc_id: r for r in spot_signatures.edited_fingerprints(docs).collect()}
    want = brute.edited(PAIRS)
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == want
    assert got[18].fingerprint == got[21].fingerprint and got[18].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert spot_signatures.edited_fingerprints(empty).count() == 0 and spot_signatures.edited_fingerprints(repeated).count() == 6
    prose = "the cat sat on the mat and the dog ate of the bone in a house by the sea with an old man who was not at home"
    some = spark.createDataFrame([(1, prose, "", "", 0), (2, prose, "", "", 0), (3, prose + " for ever", "", "", 0), (4, words(40, 9), "", "", 0)], DOCS)
    assert [(r.a, r.b) for r in spot_signatures.similar_pairs(some, 0.7).collect()] == [(1, 3)]


def test_ngram_jaccard(spark, docs, empty, repeated):
    assert rows(ngram_jaccard.link_components(docs), "n_shingles", "component_id") == brute.components(PAIRS)
    assert ngram_jaccard.link_components(empty).count() == 0
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_jaccard.link_components(repeated).collect())
    assert got == [(-1, 0, -1), (-1, 296, -1), (1, 296, 1), (1, 296, 1), (2, 56, 1), (2, 296, 1)]
    kept = ngram_jaccard.near_duplicates_removed(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in brute.components(PAIRS).values()})


def test_ngram_jaccard_near_the_threshold(spark):
    r = random.Random(1)
    texts = []
    for family in range(40):
        n = r.choice([5, 6, 8, 12, 20, 33, 64, 130])
        base = words(n, 100 + family)
        texts += [near(base, r.random(), r.randrange(0, max(2, n // 20 + 1))) for _ in range(6)] + [" ".join(base.split()[: max(1, int(n * f))]) for f in (0.75, 0.82, 0.9)]
    texts += [f"{PASSAGE} {words(12, 900 + k)}" for k in range(60)]  # one passage in many documents that link little
    got = rows(ngram_jaccard.link_components(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)), "n_shingles", "component_id")
    assert got == brute.components(list(enumerate(texts)))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_token_binary(spark, docs, empty, repeated, tmp_path):
    want = brute.tokens([(i, t or "") for i, t in PAIRS], Tokenizer.from_file(TOKENIZER))
    assert rows(token_binary.encoded(docs, TOKENIZER), "start", "n_tokens", "ids_crc32") == want
    token_binary.write_tokens(docs, str(tmp_path / "t"), TOKENIZER, chunk=100)  # many chunks, long documents in one
    assert rows(token_binary.read_tokens(spark, str(tmp_path / "t")), "start", "n_tokens", "ids_crc32") == want
    assert token_binary.encoded(empty, TOKENIZER).count() == 0
    assert [r.start for r in token_binary.encoded(repeated, TOKENIZER).orderBy("start").collect()][0] == 0 and token_binary.encoded(repeated, TOKENIZER).count() == 6


@pytest.mark.parametrize("ids", [[], [0], [65535] * 9, list(range(70000)), [2**32 - 1, 0, 7]])
def test_bit_planes_round_trip(ids):
    import numpy as np

    assert token_binary.unpack(token_binary.pack(np.array(ids, np.uint32))).tolist() == ids


PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Menu</a></nav><div class=cookie-notice>We use cookies</div>{extra}<article><h1>Head &amp; more</h1><p>One <b>two\n three</b><br>four<p>Five&nbsp;six<script>var a='<p>no</p>'</script></article><section id=comments><article><p>first!</p></article></section><aside>side</aside><form><p>mail</p></form><footer>&copy; me</footer>"
TEXT = "Head & more\nOne two three four\nFive six"


def test_extraction(spark):
    rows = [(1, "http://a.x/1", PAGE.replace("{extra}", "")), (2, None, None), (3, "::", ""), (4, "http://b.x", "plain text"), (4, "http://b.x", "<div>" * 3000 + "deep"), (5, "http://b.x", "<p>a<p>b</div></p>c &lt;d&gt; <ul><li>1<li>2"), (6, "http://c.x", "<article>unclosed <b>x"), (7, "http://c.x", PAGE.replace("{extra}", "")[:250])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "'h' AS host", "0 AS n_chars", "'q' AS templates")
    got = sorted((r.page_id, r.text, r.n_chars) for r in site_templates.extracted(pages).collect())
    assert got[0] == (1, TEXT, len(TEXT)) and got[1][1:] == got[2][1:] == ("", 0)
    assert [g[1] for g in got[3:7]] == ["deep", "plain text", "a\nb\nc <d>\n1\n2", "unclosed x"]
    assert site_templates.extracted(pages.where("false")).count() == 0


@pytest.mark.parametrize(("html", "text"), [("<p hidden>a", ""), ("<p data-x='a hidden b' data-id=nav>a", "a"), ("<div class='x sidebar-2'>a</div>b", "b"), ("<div role=banner>a</div><main>b</main>c", "b"), ("<article><header>a</header>b</article>c", "b")])
def test_what_is_left_out(html, text):
    assert site_templates.main_text(site_templates.parse(html)) == text


def test_templates_are_deleted_on_their_host_only(spark):
    box = "<div class=q17><p>Subscribe to everything we write</p></div>"
    rows = [(i, f"http://a.x/{i}", f"<body>{box}<div><p>story {i}</p></div>") for i in range(12)] + [(100, "http://b.x/", f"<body>{box}<p>other</p>")]
    got = {r.page_id: r.text for r in site_templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3" and got[100] == "Subscribe to everything we write\nother"


def test_chat(spark):
    trap = chat_format.TRAP
    turns = [(1, 0, "system", None), (1, 1, "user", "hi <|im_end|> <\\|x|>"), (1, 2, "assistant", trap), (1, 2, "assistant", trap), (2, 5, "user\n<|im_start|>", "a"), (2, None, None, "first"), (None, 0, "assistant", ""), (3, 0, "assistant", "<" * 50 + "|" + "x" * 100_000)]
    turns += [(4, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(200)]
    chats = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'f' AS formatted", "'l' AS loss")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(chat_format.formatted(chats)).collect()}
    want = brute.chats([(c, -1 if t is None else t, r, x) for c, t, r, x in turns])
    assert got == want
    assert chat_format.formatted(chats).where("rewrites").count() == 0
    assert chat_format.read_back(chat_format.formatted(chats.where("false"))).count() == 0
    assert chat_format.formatted(chat_format.with_trap(chats)).where("conv_id = -1").count() == 1


def test_templates_that_rewrite_history_are_detected():
    def numbered(turns):
        return f"[{len(turns)} turns]" + "".join(f"({r}:{t})" for r, t in turns)

    whole, spans, rewrites = chat_format.located(numbered, [("user", "a"), ("assistant", "bc")])
    assert rewrites and [whole[s[1] : s[2]] for s in spans] == ["a", "bc"]


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|x", "a<|im_end|>b", "<<||>>"])
def test_escapes_are_reversible(text):
    assert "<|" not in chat_format.escape(text) and chat_format.unescape(chat_format.escape(text)) == text
    assert chat_format.unescape_role(chat_format.escape_role(text + "\n\\n")) == text + "\n\\n"


def test_toxicity(spark, empty):
    r, rows, labels = random.Random(3), [], []
    for i in range(600):
        toxic = i % 4 == 0
        body = [f"w{r.randrange(3000)}" for _ in range(60)]
        if toxic:
            for _ in range(3):
                body[r.randrange(60)] = r.choice(["Moron", "idiot,", f"lowei{r.randrange(10**6)}", "VERMIN"])
        rows.append((i, " ".join(body), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 1), (1001, "", "en", "a", 1), (None, "idiot moron vermin", "en", "a", 1), (1002, "idiot " * 20000, "en", "a", 1)]
    labels += [(5000, 1, 1), (None, 0, 1), (3, 1, None), (1, 1, 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'s' AS score", "'p' AS spans")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 600]
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    assert sum((g.doc_id % 4 == 0) == bool(g.predicted) for g in held) >= 0.97 * len(held)
    by = {g.doc_id: g for g in got}
    assert by[1002].predicted == 1 and by[None].predicted == 1 and by[1000].predicted == by[1001].predicted == 0
    text = rows[0][1]
    a, b = map(int, by[0].spans.split(",")[0].split(":"))
    assert re.fullmatch("Moron|idiot|VERMIN|lowei[0-9]+", text[a:b])
    kept = toxicity.not_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.where("doc_id = 1002 or doc_id is null").count() == 0 and {r.score for r in kept.collect()} == {"s"}
    assert toxicity.toxicity(empty, marks).count() == 0
    assert toxicity.toxicity(docs, marks.where("false")).where("predicted = 1").count() == 0


def test_a_long_text_costs_others_no_place_in_the_sample(spark):
    rows = [(i, f"text {i} " + ("toxic" if i % 2 else "fine"), "en", "a", 1) for i in range(60)]
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    whole = toxicity.labelled_sample(spark.createDataFrame(rows, DOCS), marks, 60, 20_000)
    docs = spark.createDataFrame([(i, "long " * 5000 if i in (0, 2, 3, 5) else t, *rest) for i, t, *rest in rows], DOCS)
    texts, labels = toxicity.labelled_sample(docs, marks, 60, 20_000)
    assert sorted(texts) == sorted(t for t in whole[0] if t.split()[1] not in ("0", "2", "3", "5")) and len(texts) > 30 and set(labels) == {0, 1}
    with pytest.raises(ValueError, match="labelled 1"):
        toxicity.labelled_sample(spark.createDataFrame([(i, t * 3000 if i % 2 else t, *rest) for i, t, *rest in rows], DOCS), marks, 60, 20_000)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<main>a</main>x<div role='main'>b</div>", "a\nb"), ("<main>body<article>teaser</article></main>", "body\nteaser"), ("<article>a</article><main>b</main>", "a\nb"),
        *((f"<div class='{name}'><article>a</article></div>", "a") for name in ("content has-sidebar", "no-sidebar", "with-widget", "share-page", "banner")),
        ("<div class=widget><main>a</main></div>b", "a"), ("<div class=related><article>t</article></div>b", "b"), ("<div class=site-nav>a</div>b", "b"),
    ],
)
def test_main_text_is_whole(html, text):
    assert site_templates.main_text(site_templates.parse(html)) == text
