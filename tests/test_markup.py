"""HTML by structure against the standard library's parser, and selectors and crawler views on small pages."""

import random
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from vigil.functions import markup, urls
from vigil.sources import feeds


class Tree(HTMLParser):
    """A tree of [name, attributes, children]; text nodes are strings. For pages whose elements are all closed."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in markup.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag not in markup.VOID:
            assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][2].append(data)


def walk(node, path=()):
    if isinstance(node, str):
        return
    yield node, path
    for c in node[2]:
        yield from walk(c, (*path, node))


def said(node, drop=()):
    if isinstance(node, str):
        return [" ".join(node.split())] if node.strip() else []
    return [] if node[0] in drop else [t for c in node[2] for t in said(c, drop)]


def article_text(page):
    tree = Tree(page).root
    bad = markup.DROPPED
    for kind in ("article", "main", "body"):
        for node, path in walk(tree):
            if node[0] == kind and not any(p[0] in bad for p in path):
                return " ".join(said(node, bad))
    return " ".join(said(tree, bad | {"head", "title"}))


def random_page(r, depth=0):
    kinds = ["div", "span", "b", "ul", "section", "nav", "aside", "form", "header", "footer", "article", "main", "a", "h1", "h2", "noscript"]
    out = []
    for _ in range(r.randint(1, 4)):
        roll = r.random()
        if roll < 0.35 or depth > 4:
            out.append(r.choice(["plain text", " blanks \n", "a &amp; b", "x &lt; y", "é ½", "<!-- no > text -->", "<br>", '<img alt="a > b">']))
        elif roll < 0.42:
            out.append("<script>if (a < b) document.write('<p>no</p>')</script>" if r.random() < 0.5 else "<style>p > a {}</style>")
        else:
            k = r.choice(kinds)
            attr = f' href="/p{r.randint(0, 9)}" class="c{r.randint(0, 2)} d"' if k == "a" else f" id='i{r.randint(0, 3)}'"
            out.append(f"<{k}{attr}>{random_page(r, depth + 1)}</{k}>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_text_equals_tree(seed):
    r = random.Random(seed)
    inner = random_page(r)
    page = inner if seed % 3 == 0 else f"<!DOCTYPE html><html><head><title>T {seed}</title></head><body>{inner}</body></html>"
    got = markup.structure(page)
    assert got["text"] == article_text(page)
    tree = Tree(page).root
    assert [x["href"] for x in got["links"]] == [n[1]["href"] for n, _ in walk(tree) if n[0] == "a"]
    assert [x["label"] for x in got["links"]] == [" ".join(said(n, ("script", "style"))) for n, _ in walk(tree) if n[0] == "a"]
    assert got["headings"] == [" ".join(said(n, ("script", "style"))) for n, _ in walk(tree) if n[0] in ("h1", "h2")]


def test_pages_that_are_not_well_formed():
    assert markup.structure(None)["text"] == "" and markup.structure("a < b <3 </x> c")["text"] == "a < b <3 c"
    assert markup.structure("<body><nav>no<p>no<article>no</nav>yes<article>in<b>ner")["text"] == "in ner"
    assert markup.structure("<title>t</title><p>one<p>two<li>x<li>y")["text"] == "one two x y"
    assert markup.structure("<body>a<script>never closed <p>b")["text"] == "a"
    assert markup.structure("<p>" + "x <b" * 50_000)["text"].startswith("x <b")
    assert markup.structure("<div>" * 3000 + "deep")["text"] == "deep"


@pytest.mark.parametrize(
    ("selector", "want"),
    [("a[href]", [0, 1, 2, 3]), ("h3 a", [2]), ("a[href*='/buzz/'], h3 a", [1, 2]), ("div.box > a", None), (".box a", [1, 3]), ("#top a.k", [0]), ("a[href$='.pdf']", [3]), ("a[href^='http']", [0]), ("a.k, a[rel]", [0, 1])],
)
def test_selectors(selector, want):
    page = '<div id="top"><a class="k j" href="http://h/0">zero</a></div><div class="box"><a href="/buzz/1" rel="x">one</a></div><h3><b><a href="2">two</a></b></h3><p class="box"><a href="3.pdf">three</a></p><a name="n">none</a>'
    hrefs = ["http://h/0", "/buzz/1", "2", "3.pdf"]
    if want is None:
        with pytest.raises(ValueError, match="not understood"):
            markup.structure(page, selector)
    else:
        assert [hrefs.index(x["href"]) for x in markup.structure(page, selector)["links"]] == want


def test_links_under_a_selector_and_not_seen(spark):
    html = '<ul class="list"><li><a href="../a.html">A long enough title</a></li><li><a href="?q=1">Another title of a page</a></li><li><a href="http://h.in/seen">One that was seen before</a></li></ul><a href="/x">Outside of any list</a>'
    pages = spark.createDataFrame([("https://h.in/d/e/p.html?z=1", html), ("https://h.in/d/f/p.html", html), ("https://n.in", None)], "url string, html string")
    seen = spark.createDataFrame([("http://h.in/seen",)], "url string")
    got = sorted((r.url, r.link) for r in feeds.page_links(pages, selector=".list a", seen=seen).collect())
    assert got == [("https://h.in/d/e/p.html?z=1", "https://h.in/d/a.html"), ("https://h.in/d/e/p.html?z=1", "https://h.in/d/e/p.html?q=1"), ("https://h.in/d/f/p.html", "https://h.in/d/f/p.html?q=1")]


@pytest.mark.parametrize("href", ["x", "../x", "../../../x", "./x?y#z", "/a/../b", "//o.in/p", "?q=2", "#f", "", "http://o/x", "mailto:a@b", "a/b/", "..", ".", "g;x=1/../y"])
def test_links_join_as_the_standard_library_does(spark, href):
    for base in ("http://h.in/a/b/c?d=1#e", "http://h.in", "http://h.in/", "https://h.in/a/"):
        got = spark.range(1).select(urls.absolute(F.lit(base), F.lit(href)).alias("u")).first().u
        assert got == urljoin(base, href), (base, href)


def test_crawler_view_and_article(spark):
    html = '<h1>Top <b>x</b></h1><script>fetch("/a")</script><link rel="canonical"><p>some  text</p><script type="application/ld+json">{}</script>'
    df = spark.createDataFrame([(html,), (None,), ('é <tr class="table-row-hover">fetch(',)], "h string")
    a, b, c = (r.v for r in df.select(markup.crawler_view("h").alias("v")).collect())
    assert (a.headings, a.jsonld_blocks, a.has_canonical, a.js_dependent, a.case_rows, a.text_preview) == (["Top <b>x</b>"], 1, True, True, 0, "Top x some text")
    assert b.html_chars == 0 and not b.js_dependent and c.case_rows == 1 and not c.js_dependent and c.html_bytes == c.html_chars + 1
    texts = spark.createDataFrame([("<main>" + "word " * 100, "s"), ("<p>short", "snippet"), ("<p>short", "")], "h string, s string")
    got = [r.t for r in texts.select(markup.article(markup.page("h")["text"], 300, 200, "s").alias("t")).collect()]
    assert len(got[0]) == 300 and got[1:] == ["snippet", "short"]
