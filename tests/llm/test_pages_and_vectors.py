"""HTML extraction, WARC derivatives and vector searches."""

import html
import json
import os
import re
import time
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import hamming, html_main, multi_index, warc

MEDIUM = os.environ.get("TEST_MEDIUM_DIR", "/root/testdata/sf0.1")
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def trees():
    return html_main.fit()


def test_extract_article_of_every_page(spark, sf, trees):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_main.extract(pages, model=trees).collect():
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_held_out_layouts(trees):
    make = html_main._Layouts(77)
    survey, labels = html_main.labelled_survey([make.page() for _ in range(150)])
    keep = html_main.decode(survey, trees)
    rows = np.flatnonzero(survey.judged & (survey.own > 0) & (labels < 2))
    assert (keep[rows] == labels[rows]).mean() > 0.97
    assert not (keep & ~keep[survey.parent]).any()  # nothing is kept under a rejected element


class OtherGrammar:
    """Pages of another kind than those learned from: nested boxes named by block and
    element, several columns, other wordings, adverts by data attributes and networks."""

    def __init__(self, seed):
        import random

        self.r = random.Random(seed)

    def text(self, n):
        return " ".join(self.r.choice("It was seen that many people of the town had come by train, and some on foot; nobody knew why.".split()) for _ in range(self.r.randint(2, n))) + "."

    def page(self):
        r, t = self.r, self.text
        keep, gone = (lambda x: f"<!--a-->{x}<!--b-->"), (lambda x: f"<!--x-->{x}<!--y-->")
        nav = f'<div class="{r.choice(["l-header__nav", "main-navigation", "globalNav", "menu-primary"])}"><ul>' + "".join(f'<li class="item-{i}"><a href="/{i}">{t(3)}</a></li>' for i in range(r.randint(3, 8))) + "</ul></div>"
        ad = lambda: r.choice(['<div class="c-ad__slot" data-ad-unit="7">{}</div>', '<ins class="adsbygoogle">{}</ins>', '<div id="dfp-ad-3">{}</div>', '<div class="sponsored-links"><p>{}</p></div>', '<aside class="promoBox">{}</aside>']).format(t(20))
        paragraphs = [f'<p class="{r.choice(["article__paragraph", "para", "has-drop-cap", ""])}">{t(60)}</p>' for _ in range(r.randint(3, 9))]
        paragraphs.insert(1, f'<h2 id="{r.choice(["legal-questions", "the-side-road", "notice-of-change", "form-and-style"])}">{t(6)}</h2>')
        paragraphs.insert(2, f'<section class="{r.choice(["menu-of-the-day", "social-history", "search-and-find", "header-text"])}"><p>{t(50)}</p><p>{t(40)}</p></section>')
        if r.random() < 0.5:
            paragraphs.insert(r.randint(1, len(paragraphs)), gone(ad()))
        body = keep(r.choice(['<div class="article__body">{}</div>', '<div class="post-content">{}</div>', "<article>{}</article>", '<main id="main-content"><div class="entry">{}</div></main>']).format(f"<h1>{t(8)}</h1>" + "".join(paragraphs)))
        side = gone(f'<div class="{r.choice(["l-sidebar", "sidebar-right", "rightRail", "widget-area"])}"><h3>{t(3)}</h3><ul>' + "".join(f'<li><a href="/x{i}">{t(6)}</a></li>' for i in range(4)) + "</ul></div>")
        end = gone(f'<div class="{r.choice(["l-footer", "site-footer", "footerMain"])}"><p>{t(12)}</p></div>')
        extra = gone(r.choice([f'<div class="cookie-banner__inner"><p>{t(30)}</p><button>OK</button></div>', f'<div class="newsletterSignup"><p>{t(20)}</p><form><input name="e"></form></div>', ad()]))
        says = gone('<div class="comments-area">' + "".join(f'<div class="comment__item"><p>{t(30)}</p></div>' for _ in range(r.randint(1, 4))) + "</div>")
        return f'<html><body><div class="layout"><div class="row">{gone(nav)}</div>{extra}<div class="columns">{body}{side}</div>{says if r.random() < 0.5 else ""}{end}</div></body></html>'


def test_another_grammar(trees):
    make = OtherGrammar(5)
    survey, labels = html_main.labelled_survey([make.page() for _ in range(150)])
    keep = html_main.decode(survey, trees)
    rows = np.flatnonzero(~survey.hidden & (survey.own > 0) & (labels < 2))
    assert (keep[rows] == labels[rows]).mean() > 0.97


ARTICLES = [
    ('<h1>Title</h1><section class="side-effects"><p>Most people who take it sleep well, but some report headaches.</p><p>Tell your doctor.</p></section><p>More text follows here.</p>', "Title\nMost people who take it sleep well, but some report headaches.\nTell your doctor.\nMore text follows here."),
    ('<div class="search-and-rescue"><p>The search and rescue team went out at dawn, and came back.</p></div>', "The search and rescue team went out at dawn, and came back."),
    ('<p>This is <span class="text-legal">the legal side</span> of the <em id="social">social</em> matter, and it goes on.</p>', "This is the legal side of the social matter, and it goes on."),
    ('<p>Real text of the article stands here, and it is long.</p><ins class="adsbygoogle">Buy now at the shop</ins><div class="dfp-slot">Cheap flights here</div><p>More <span class="advertorial-slot">great offers</span> text <span data-ad="1">click this</span> here.</p>', "Real text of the article stands here, and it is long.\nMore text here."),
]


@pytest.mark.parametrize(("article", "text"), ARTICLES)
def test_names_are_weighed_not_listed(trees, article, text):
    assert html_main.main_text(f"<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{article}</article><footer>About us</footer></body>", trees) == text


def test_page_parts_are_left_out(trees):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="x"><header class="site-header"><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site, please accept.</p><button>OK</button></div>
<article><h1>Caf&eacute;&nbsp;story</h1><p>First   paragraph,<br>with <b>bold</b> text &amp; more words to read.<script>var a = "</p>";</script><p>Second paragraph goes on for a while, with commas, and stops.</article>
<aside class="sidebar"><p>Other stories you may like to read today.</p></aside><section class="comments"><h2>Comments</h2><div class="comment"><p>I liked this story a lot, thank you.</p></div></section>
<form action="/s"><label>Search</label><input name="q"></form><footer>&copy; Site</footer></body></html>"""
    assert html_main.main_text(page, trees) == "Café story\nFirst paragraph, with bold text & more words to read.\nSecond paragraph goes on for a while, with commas, and stops."


def test_extract_edges(spark, trees):
    long = "<article>" + "<p>word " * 60000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain text only"), (4, "u", long), (5, "u", "<div " * 2000), (5, "u", "<p>a < b</p></div></p><td>x"), (6, "u", "<div>" * 3000 + "deep")]
    got = html_main.extract(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit(1)), model=trees).collect()
    assert len(got) == 7 and [r.text for r in got[:3]] == ["", "", "plain text only"]
    assert html_main.extract(spark.createDataFrame([], PAGES), model=trees).count() == 0


HOSTILE = ["<div ", "</div>", '<a ="x>', "<!x ", "<p><td><h1>", "<b><li>", "<div a", "&amp;<b>", "<div>", "<b>x", "<p>x", "<b class=x>y"]


@pytest.mark.parametrize("part", HOSTILE)
def test_hostile_pages_take_linear_time(trees, part):
    """Five million characters of each take about four times as long as a quarter of them.
    CPU seconds, with room for a busy machine; the bound is in turns of a loop of 20 ms."""

    def took(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    turn = min(took(lambda: sum(range(1_000_000))) for _ in range(5)) / 0.02
    some, whole = (took(lambda: html_main.main_text(part * (n // len(part)), trees)) for n in (1_250_000, 5_000_000))
    assert whole < 7 * some + turn and whole < 25 * turn


def test_hostile_pages_fit_into_little_memory():
    import subprocess
    import sys

    code = "import resource; from tabloom.llm import html_main as h; m = h.fit(8)\nbefore = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nfor p in ('<div>', '<p>x', '<b>x'): h.main_text(p * (5_000_000 // len(p)), m)\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.getcwd()).stdout.split()[-1]) < 500


def test_inline_and_custom_parts_are_left_out(trees):
    page = """<body><article><h1>Title of it</h1><p>Some text here that is long enough to be read as a paragraph.</p><span class="ad">Buy now our product</span>
<x-cookie-banner>We use cookies</x-cookie-banner><p>More text <em>here</em>, <span>plain</span> and <a class="external" href="/x">a link</a> <ins class="sponsored">Great deals</ins> to the end.</p></article></body>"""
    assert html_main.main_text(page, trees) == "Title of it\nSome text here that is long enough to be read as a paragraph.\nMore text here, plain and a link to the end."


def test_references_are_of_one_text_node(trees):
    assert html_main.main_text("<p>&am<b>p;</b> &lt;i&gt; &#x41;&notit; &nosuch; x&nbsp;y</p>", trees) == "&amp; <i> A¬it; &nosuch; x y"


def test_references_of_very_many_digits(spark, trees):
    """The library's own decoder raises on a decimal number of more than 4,300 digits."""
    many, zeros = "&#" + "7" * 5000 + ";", "&#" + "0" * 5000 + "65;"
    page = f'<title>A {many}</title><article class="{many}"><p id="x{many}">One {many} two {zeros}.</p><a href="" src="/y{zeros}">z</a></article>'
    rows = [(1, "u", page), (2, "u", many), (3, "u", "&#" + "0" * 5000)]
    assert [r.text for r in html_main.extract(spark.createDataFrame(rows, PAGES), model=trees).collect()] == ["One \ufffd two A.\nz", "\ufffd", "\ufffd"]
    got = {r.record_type: r for r in warc.derive(warc.responses_of_pages(spark.createDataFrame(rows[:1], PAGES))).collect()}
    assert got["metadata"].title == "A \ufffd" and json.loads(got["metadata"].block)["links"] == [{"path": "a@/src", "url": "/yA"}]
    assert [html_main.unescape(x) for x in ("&#65;&amp;#66;&#x41;&#233", "&#", "&#;", "&#x" + "0" * 5000 + "41;")] == ["A&#66;Aé", "&#", "&#;", "A"]


# Pages written by hand in other styles than the grammar's: what is kept, and all the rest.
STYLES = [
    ("""<html><body><table><tr><td id="sidebar"><a href="/">Home</a> <a href="/x">Archive</a></td><td id="content"><h2>The river at dawn</h2><p>The river rises in the hills, and by the time it meets the town it is wide and slow.</p><p>Boats lie along the bank; few of them move before noon.</p></td></tr></table><div id="footer">All rights reserved</div></body></html>""", ["The river at dawn", "wide and slow", "before noon"], ["Archive", "rights reserved"]),
    ("""<body><div id="page"><div id="masthead"><a href="/">Daily</a></div><ul class="nav-menu"><li><a href="/1">World</a><li><a href="/2">Sport</a></ul><div id="story-body"><p class="lead">A new bridge was opened on Monday, after six years of work.</p><div class="promo-box"><p>Subscribe to our letter today.</p></div><p>It carries trains, cars and bicycles, and cost less than planned.</p></div><div id="related-links"><ul><li><a href="/3">Old bridge</a></ul></div></div></body>""", ["opened on Monday", "less than planned"], ["Sport", "letter today", "Old bridge"]),
    ("""<main role="main"><article><header><h1>How to bake bread</h1></header><section><h2>Flour</h2><p>Use strong flour, and weigh it, as cups differ.</p></section><section><h2>Time</h2><p>Let it rest overnight: the dough does the work.</p></section><footer><p>Share this</p></footer></article></main><section id="comments"><h3>2 comments</h3><article class="comment"><p>Mine never rises, what do I do wrong?</p></article></section>""", ["How to bake bread", "cups differ", "does the work"], ["Mine never rises"]),
    ("""<body><nav><a href="/">Start</a></nav><div class="container"><div class="row"><div class="col post-content"><p>First we measured the height of the tower with a stick and its shadow.</p><pre>h = s * H / S</pre><blockquote>Measure twice.</blockquote></div><div class="col sidebar-right"><h4>Popular</h4><ul><li><a href="/a">Ten tricks</a></li></ul></div></div></div><div class="cookie-consent">We value your privacy. <button>OK</button></div></body>""", ["stick and its shadow", "s * H", "Measure twice"], ["Ten tricks", "your privacy"]),
]


@pytest.mark.parametrize(("page", "kept", "gone"), STYLES)
def test_other_styles(trees, page, kept, gone):
    text = html_main.main_text(page, trees)
    assert all(k in text for k in kept) and not any(g in text for g in gone), text


# --- WARC ---------------------------------------------------------------------------


class _Plain(HTMLParser):
    """Title, link addresses and words of a page, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.in_title, self.title, self.links, self.text = 0, False, "", [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        url = a.get("href", a.get("src"))
        if tag in ("a", "area", "link", "img", "script", "iframe") and url:
            self.links.append(url)
        self.in_title |= tag == "title"
        self.hidden += tag in html_main.SKIP
        self.text.append("\n" if tag in html_main.BLOCK or tag == "br" else "")

    def handle_endtag(self, tag):
        self.in_title &= tag != "title"
        self.hidden -= tag in html_main.SKIP
        self.text.append("\n" if tag in html_main.BLOCK else "")

    def handle_data(self, data):
        self.title += data if self.in_title else ""
        self.text.append("" if self.hidden else data)


def plain_page(page):
    p = _Plain()
    p.feed(page)
    p.close()
    return " ".join(p.title.split()), p.links, "".join(p.text).split()


def test_warc_any_charset(spark):
    """No charset name and no bytes stop the builder; the text is always valid."""
    names = ["undefined", "idna", "utf-7", "unicode_escape", "raw_unicode_escape", "punycode", "utf-16", "utf-32", "hex", "rot13", "zlib", "base64", "utf-8-sig", "cp037", "big5", "iso-2022-jp", "no-such", "-", "\u00e9", "mbcs", "latin-1"]
    rng = np.random.default_rng(0)
    bodies = [b"<p>caf\xe9 +2AA- \\ud800 xn--a.b" + b"a" * 300, bytes(rng.integers(0, 256, 500, dtype=np.uint8)), b"", "<p>\u65e5\u672c".encode("utf-16")]
    rows = [(f"<urn:{n}:{k}>", "http://a", None, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={n}\r\n\r\n".encode() + body) for n in names for k, body in enumerate(bodies)]
    rows += [(f"<urn:meta:{n}>", "http://a", None, b"HTTP/1.1 200 OK\r\n\r\n" + f"<meta charset='{n}'><p>x".encode()) for n in names]
    got = warc.derive(spark.createDataFrame(rows, "record_id string, target_uri string, date string, block binary")).collect()
    assert len(got) == 2 * len(rows) and all(r.content_length == len(r.block.encode()) for r in got)


def test_serialise_edges(spark):
    rows = [("<urn:x>", "http://a\r\nX: y", "2020-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>" + b"word " * 400_000)] * 2 + [(None, None, None, None)]
    records = warc.derive(spark.createDataFrame(rows, "record_id string, target_uri string, date string, block binary"))
    back = warc.read_records(b"".join(bytes(r.warc) for r in warc.serialise(records).collect()))
    assert len(back) == 6 and sum(len(b) > 1_999_000 for _, b in back) == 2
    assert all("X" not in h and h["WARC-Block-Digest"] == warc.digest(b) for h, b in back)
    assert warc.serialise(records.limit(0)).count() == 0


def test_warc_records_link_and_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    responses = warc.responses_of_pages(pages)
    source = {r.record_id: r for r in responses.collect()}
    assert len(source) == pages.count()
    got = warc.derive(responses, keep=("page_id",)).cache()
    by = defaultdict(dict)
    for r in got.collect():
        by[r.refers_to][r.record_type] = r
    assert set(by) == set(source) and all(set(v) == {"metadata", "conversion"} for v in by.values())
    for rid, pair in by.items():
        block = bytes(source[rid].block)
        for r in pair.values():
            assert r.source_block_digest == warc.digest(block) and r.target_uri == source[rid].target_uri and r.block_digest == warc.digest(r.block.encode())
            assert dict(json.loads(r.source_headers))["Content-Type"] == "text/html; charset=utf-8"
        facts = json.loads(pair["metadata"].block)
        assert facts["payload_digest"] == warc.digest(block.split(b"\r\n\r\n", 1)[1]) and len(facts["links"]) == pair["metadata"].n_links
        title, links, text = plain_page(block.split(b"\r\n\r\n", 1)[1].decode())
        assert [x["url"] for x in facts["links"]] == links and facts["title"] == title == pair["conversion"].title
        assert pair["conversion"].block.split() == text and facts["block_digest"] == warc.digest(block)
    data = b"".join(bytes(r.warc) for r in warc.serialise(got).orderBy("record_id").collect())
    records = warc.read_records(data)
    assert len(records) == 2 * len(source)
    for head, block in records:
        assert head["WARC-Block-Digest"] == warc.digest(block) and head["WARC-Refers-To"] in source
        whole = bytes(source[head["WARC-Refers-To"]].block)
        assert head["WARC-Source-Block-Digest"] == warc.digest(whole) and head["WARC-Source-Payload-Digest"] == warc.digest(whole.split(b"\r\n\r\n", 1)[1])
        assert dict(json.loads(head["WARC-Source-Headers"]))["Content-Type"] == "text/html; charset=utf-8"


def test_warc_query_returns_bodies(spark, sf):
    from tabloom.llm.queries import QUERIES

    rows = QUERIES["op10_warc_derivatives"](spark, sf).collect()
    assert rows and all(r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode()) for r in rows)


def test_warc_edges(spark):
    rows = [(None, None, None, None), ("<urn:x>", "http://a", "2020-01-01T00:00:00Z", b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=latin-1\r\nX-A: b: c\r\n\r\n<p>caf\xe9</p>"), ("<urn:x>", "http://a", "2020-01-01T00:00:00Z", b"no headers at all")]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, date string, block binary").withColumn("title", F.lit(1))
    got = warc.derive(df).collect()
    assert len(got) == 6 and {r.block for r in got if r.record_type == "conversion"} == {"", "café"}
    assert dict(json.loads(next(r.source_headers for r in got if "404" in r.block)))["X-A"] == "b: c"
    assert warc.derive(df.limit(0)).count() == 0


# --- searches -----------------------------------------------------------------------


def vectors(df):
    rows = df.collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)


def test_multi_index_recall_and_exact_scores(spark):
    df = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    ids, x = vectors(df)
    got = defaultdict(list)
    for r in multi_index.search(df, scan_least=200).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    right, at = 0, {i: n for n, i in enumerate(ids)}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = np.lexsort((ids, -s))
        want = {int(ids[j]) for j in order[order != q][:20]}
        mine = sorted(got[ids[q]])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(sc - s[at[v]]) < 1e-12 for _, v, sc in mine)
        right += len(want & {v for _, v, _ in mine}) / 20
    assert right / (ids % 20 == 0).sum() >= 0.9


def test_hamming_is_exact(spark):
    df = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    ids, x = vectors(df)
    got = defaultdict(list)
    for r in hamming.exact_top_k(df, block_rows=600).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.distance))
    for q in np.flatnonzero(ids % 20 == 0):
        d = ((x > 0) != (x[q] > 0)).sum(1)
        order = np.lexsort((ids, d))
        order = order[order != q][:20]
        assert sorted(got[ids[q]]) == [(n + 1, int(ids[j]), int(d[j])) for n, j in enumerate(order)]


def test_hamming_takes_every_component(spark):
    rng = np.random.default_rng(6)
    for width in (5, 64, 150):
        x = rng.normal(size=(300, width))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = defaultdict(list)
        for r in hamming.exact_top_k(df, block_rows=70).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.distance))
        for q in range(0, 300, 20):
            d = ((x > 0) != (x[q] > 0)).sum(1)
            order = np.lexsort((np.arange(300), d))
            assert sorted(got[q]) == [(n + 1, int(j), int(d[j])) for n, j in enumerate(order[order != q][:20])]


def test_hamming_blocks_of_a_span_hand_on_one_list(spark, monkeypatch):
    """Lists grew as queries times blocks, whatever the size of a block."""
    x = np.random.default_rng(8).normal(size=(3000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    lists, merge = [], hamming.top_of
    monkeypatch.setattr(hamming, "top_of", lambda parts, *a: lists.append(parts.count()) or merge(parts, *a))
    small, large = (sorted(hamming.exact_top_k(df, block_rows=n).collect()) for n in (30, 5000))
    assert small == large and len(small) == 3000 and lists == [150, 150]


@pytest.mark.parametrize("search", [multi_index.search, hamming.exact_top_k])
def test_search_edges(spark, search):
    """Copies of one vector in most rows, unusable vectors, few candidates."""
    same = [1.0, 2.0, -1.0]
    rows = [(i, same) for i in range(50)] + [(50, None), (51, []), (52, [0.0, 0.0, 0.0]), (53, [1.0, None, 2.0]), (54, [float("nan"), 1.0, 1.0]), (55, [float("inf"), 1.0, 1.0]), (None, same), (60, [-1.0, 0.5, 1.0]), (61, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in search(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    assert set(got) == {0, 20, 40, 60}
    assert [v for _, v in sorted(got[20])] == [i for i in range(22) if i != 20][:20]
    assert [v for _, v in sorted(got[60])] == list(range(20))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in search(few).collect()] == [(0, 1, 1)]
    assert search(df.limit(0)).count() == 0


def test_a_whole_walk_has_one_list_a_query_and_span(spark, monkeypatch):
    """Not one for each shard, of which there are as many as the table has times 8 rows."""
    import numpy as np

    from tabloom.llm import multi_index

    x = np.random.default_rng(4).integers(-3, 4, (600, 6)).astype(float) + 0.5
    x[100:140] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    lists, top_of = [], multi_index.top_of
    monkeypatch.setattr(multi_index, "top_of", lambda parts, *a: lists.append(parts.count()) or top_of(parts, *a))
    got = {}
    for r in multi_index.search(df, scan_share=1.0, scan_least=1, shard_rows=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    score = x @ x.T
    want = {q: [(n + 1, i, score[q, i]) for n, i in enumerate(sorted((i for i in range(600) if i != q), key=lambda i: (-score[q, i], i))[:20])] for q in range(0, 600, 20)}
    assert {q: sorted(v) for q, v in got.items()} == want
    assert 0 < lists[0] <= 30
