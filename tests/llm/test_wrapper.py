import html
import itertools
import re

import duckdb

from sparkloom.llm import wrapper as wr
from sparkloom.llm.dom import Node, parse
from sparkloom.llm.queries import QUERIES


def test_query_against_known_layout(spark):
    """The test pages keep their main text in one article of h1 and p."""
    d = "/root/testdata/sf0.01"
    pages = duckdb.sql(f"select page_id, url, html from '{d}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in QUERIES["op5_main_text"](spark, d).collect()}
    assert len(got) == len(pages)
    for i, u, h in pages:
        inside = re.search(r"<article>(.*?)(</article>|$)", h, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[i].text == "\n".join(p for p in parts if p) and got[i].url == u and got[i].n_chars == len(got[i].text)


def page(body, n):
    return f"""<html><head><title>t{n}</title><script>if (a < b) x("</p>")</script></head><body class="has-sidebar">
    <nav><ul><li><a href=/>Home {n}</a></ul></nav><div id="top">Great Site of Things</div><div class=story>{body}</div>
    <div class="cookie-notice">We use cookies {n}</div><form><p>Search {n}</form><aside><p>See also {n}</aside>
    <section id="comments"><article><p>First! {n}</article></section><div>All rights are with us</div><footer>&copy; {n}</footer>"""


def test_template_texts_go():
    bodies = [f"<h2>Head {n}</h2><p>One <b>bold</b>&nbsp;word {n} &amp; more<br>next<p>Two {n * 7}" for n in range(6)]
    pages = [page(b, n) for n, b in enumerate(bodies)]
    wrapper = wr.induce(pages)
    assert {t for ts in wrapper.values() for t in ts} == {"Great Site of Things", "All rights are with us"}
    assert wr.main_text(pages[3], wrapper) == "Head 3\nOne bold word 3 & more next\nTwo 21"
    assert "Great Site of Things" in wr.main_text(pages[3])
    # copies of one page are no evidence of a template
    assert wr.induce([pages[0]] * 5 + [pages[1]]) == {}


def test_an_article_is_kept_whole():
    p = "<div>menu</div><article class='post'><header><h1>T</h1></header><p>a<div class=ads>buy</div><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><pre> p  q </pre></article><p>after"
    assert wr.main_text(p) == "T\na\nx\ny\n1\n2\np q"
    for broken in ("<p>a</", "<p>a<foo", "<p>a<foo x='", "<p>a<!-- b", "<p>a<script>b"):
        assert wr.main_text(broken) == "a", broken
    wide = "<form id=aspnet><div class='page has-sidebar'><div class=top-menu>m</div><main><p>kept<div class='share-bar'>s</div></main><div class=sidebar><article>card</article></div><aside><article>card</article></aside></div></form>"
    assert wr.main_text(wide) == "kept"
    assert wr.main_text("1 < 2 & 3") == "1 < 2 & 3" and wr.main_text("") == wr.main_text(None) == ""
    deep = "<div>" * 30000 + "x"
    assert wr.main_text(deep) == "x" and wr.induce([deep] * 6) == {}


def slow_match(a, b):
    """Tree matching by trying all order-preserving pairings."""
    if a.label != b.label:
        return 0
    best = 0
    for k in range(min(len(a.children), len(b.children)) + 1):
        for x in itertools.combinations(a.children, k):
            for y in itertools.combinations(b.children, k):
                m = [slow_match(p, q) for p, q in zip(x, y)]
                best = max(best, sum(m) if all(m) else 0)
    return best + 1


def test_alignment_is_optimal():
    trees = [parse(h) for h in ("<div><p>a<p>b<ul><li>c<li>d</ul></div><p>e", "<div><p>a<ul><li>c</ul><p>b</div><div>z</div><p>e", "<p>q<div><ul><li>d<li>x<li>y</ul></div>")]
    for a, b in itertools.product(trees, trees):
        size, pairs = wr.align(a, b)
        assert int(size + 0.5) == slow_match(a, b) == len(pairs)
    assert wr.align(Node("a"), Node("b")) == (0.0, [])


def test_odd_rows(spark):
    rows = [(n, f"http://Host.example/{n}", page(f"<p>text {n}<p>more {n}<p>end {n}", n), "k") for n in range(8)] + [(3, None, "<p>no host", "k"), (None, "http://host.example/x", None, "k"), (9, "nonsense", "", "k"), (10, "http://u@host.example:80/", page("<p>" + "w " * 100000, 10), "k"), (10, "http://u@host.example:80/", page("<p>" + "w " * 100000, 10), "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, template string")
    for most in (0, 1 << 20):
        got = {(r.page_id, r.url): (r.text, r.n_chars) for r in wr.extract(df, most_broadcast=most).collect()}
        assert len(got) == 12
        assert got[4, "http://Host.example/4"] == ("text 4\nmore 4\nend 4", 19) and got[3, None] == ("no host", 7)
        assert got[None, "http://host.example/x"] == got[9, "nonsense"] == ("", 0)
        assert got[10, "http://u@host.example:80/"][1] == 199999
    assert wr.extract(df.limit(0)).count() == 0


def slow_align(a, b):
    """The best matching by trying every order-preserving pairing of children, with its pairs."""
    if a.label != b.label:
        return 0.0, []
    if a.tag == "#":
        return (1.001 if a.text == b.text else 1.0), [(a, b)]
    table = {}

    def best(i, j):
        if (i, j) not in table:
            if i == len(a.children) or j == len(b.children):
                table[i, j] = 0.0, []
            else:
                value, pairs = slow_align(a.children[i], b.children[j])
                rest = best(i + 1, j + 1)
                table[i, j] = max([best(i + 1, j), best(i, j + 1)] + ([(value + rest[0], pairs + rest[1])] if value else []), key=lambda x: x[0])
        return table[i, j]

    size, pairs = best(0, 0)
    return size + 1, [(a, b), *pairs]


def test_templates_of_any_size_against_a_plain_aligner():
    for lines in (1, 2, 3, 6, 10, 50):
        top = "".join(f"<p>Template line {k} of the host" for k in range(lines))
        pages = [f"<body><div class=top-{n}>{top}</div><div class=story><p>One {n * 31}<p>Two {n * 17} and more<p>Three {n * 7}</div><div>The end</div>" for n in range(1, 7)]
        wrapper = wr.induce(pages)
        trees = [parse(p) for p in pages]
        slow = {x.text for x, y in slow_align(trees[0], trees[1])[1] if x.tag == "#" and x.text == y.text}
        assert {t for ts in wrapper.values() for t in ts} == slow and len(slow) == lines + 1
        for n, p in enumerate(pages, 1):
            assert wr.main_text(p, wrapper) == f"One {n * 31}\nTwo {n * 17} and more\nThree {n * 7}"
    # an odd page, a second layout and copies undo nothing
    odd = ["<main><p>quite another page</main>", "<table><tr><td>1"] + [pages[0]] * 3
    assert {t for ts in wr.induce(pages + odd).values() for t in ts} == slow
    assert wr.induce([pages[0].replace("One", f"One {k}") for k in range(2)] * 3) == {}


def test_names_of_regions():
    kept = ("overflow-hidden", "share-prices", "card-related", "search-results", "no-comments notice-of-meeting", "has-sidebar", "menuconfig", "header-image-caption")
    for name in kept:
        assert wr.main_text(f"<body><div class='{name}'><p>whole text</div>") == "whole text", name
        assert wr.main_text(f"<article><p>a<div class='{name}'><p>b</div><p>c</article>") == "a\nb\nc", name
    for name in ("ads", "cookie-notice", "top-menu", "site-footer", "newsletter-signup box", "comments", "related-posts", "sidebar_left"):
        assert wr.main_text(f"<body><div class='{name}'><p>gone</div><p>here") == "here", name
    assert wr.main_text("<article><p>a<div class='ad'>gone</div><section id=comments><p>gone</section><nav>gone</nav><p hidden>gone<p>b</article>") == "a\nb"


def test_text_of_formulas_and_odd_elements():
    assert wr.main_text("<p>E is <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>mc^2</annotation></math> here") == "E is mc2 here"
    assert wr.main_text("<p>see <svg><title>t</title><g><text>A</text></g></svg> and <object data=x>plain</object>") == "see A and\nplain"
    assert wr.main_text("<p>a<xmp>if (a < b) <i>x</i></xmp><p>b<svg/>c") == "a\nif (a < b) <i>x</i>\nbc"
