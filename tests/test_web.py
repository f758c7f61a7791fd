"""Data sources over HTTP against a small server on this machine."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from vigil.sources import feeds, web

ITEM = "<item><title>Headline  {i}</title><link>https://p.in/{i}</link><description>Some\n text</description><pubDate>Mon, 01 Jan 2024 23:30:00 -0500</pubDate>{more}</item>"
GOOD = "<rss version='2.0'><channel><title>feed</title>" + "".join(ITEM.format(i=i, more="") for i in range(70)) + "<item><title>no link</title></item></channel></rss>"
SPARE = "<rss><channel>" + ITEM.format(i=900, more="<source url='https://publisher.in'>The Publisher</source>") + "</channel></rss>"
ATOM = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>An <b>entry</b></title><link rel='self' href='x'/><link href='https://a.in/1'/><updated>2024-03-01T10:00:00Z</updated><summary>s</summary></entry></feed>"
PAGE = "<nav><a href='/skip'>A link of the navigation</a></nav><ul class='l'>" + "".join(f"<li><a href='n/{i}'>A notice of number {i:03d}</a></li>" for i in range(60)) + "<li><a href='n/1'>A notice that is there twice</a></li><li><a href='n/x'>short</a></li></ul>"
BROKEN = GOOD[: GOOD.index("Headline  5")]
ROWS = [{"id": i, "date": f"2024-{1 + i % 12:02d}-01", "company": f"c{i}", "n": i * 1.5} for i in range(95)]


class Handler(BaseHTTPRequestHandler):
    log: list = []

    def do_GET(self):
        at = urllib.parse.urlparse(self.path)
        asked = urllib.parse.parse_qs(at.query)
        Handler.log.append((at.path, asked))
        files = {"/good": GOOD, "/spare": SPARE, "/atom": ATOM, "/page": PAGE, "/broken": BROKEN, "/empty": "<rss><channel/></rss>"}
        if at.path in files:
            return self.answer(200, files[at.path].encode())
        if at.path != "/rest/cases" or "slug" in asked["select"][0]:
            return self.answer(400 if at.path == "/rest/cases" else 500, b"no")
        rows = ROWS
        for key in set(asked) - {"select", "order", "limit", "offset"}:
            for test in asked[key]:
                op, _, v = test.partition(".")
                rows = [r for r in rows if {"gte": str(r[key]) >= v, "eq": str(r[key]) == v, "in": str(r[key]) in v.strip("()").split(","), "not": True, "like": str(r[key]).startswith(v.rstrip("*"))}[op]]
        rows = rows[int(asked["offset"][0]) :][: int(asked["limit"][0])]
        return self.answer(200, json.dumps([{c: r[c] for c in asked["select"][0].split(",")} for r in rows]).encode())

    def answer(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_sources_fail_alone_and_fall_back(spark, server):
    registry = [
        {"name": "good", "url": f"{server}/good", "kind": "rss", "domain": "p.in", "is_primary": True},
        {"name": "atom", "url": f"{server}/atom", "kind": "rss"},
        {"name": "broken", "url": f"{server}/broken", "kind": "rss", "domain": "b.in"},
        {"name": "page", "url": f"{server}/page", "kind": "docwatch", "domain": "d.in", "selector": ".l a"},
        {"name": "down", "url": f"{server}/nothing", "kind": "rss", "domain": "gov.in", "is_primary": True, "always_relevant": True, "fallback_url": f"{server}/spare"},
        {"name": "dark", "url": "http://127.0.0.1:1/x", "kind": "rss", "fallback_url": f"{server}/empty"},
    ]
    asked = []
    items, health = feeds.sense(spark, registry, lambda r: asked.append(r) or web.fetch(spark, r, 5))
    got = {r.source: (r.status, r["items"]) for r in health.collect()}
    assert got == {"good": ("ok", 60), "atom": ("ok", 1), "broken": ("ok", 5), "page": ("ok", 61), "down": ("fallback", 1), "dark": ("blocked", 0)}
    assert web.fetch(spark, asked[0]).rdd.getNumPartitions() == len(registry)
    rows = items.collect()
    spare = next(r for r in rows if r.name == "down")
    assert (spare.source, spare.publisher_url, spare.is_primary, spare.always_relevant) == ("The Publisher", "https://publisher.in", False, False)
    first = next(r for r in rows if r.name == "good" and r.position == 0)
    assert (first.title, first.summary, first.published, first.source, first.is_primary) == ("Headline 0", "Some text", "2024-01-02", "p.in", True)
    atom = next(r for r in rows if r.name == "atom")
    assert (atom.title, atom.url, atom.published) == ("An entry", "https://a.in/1", "2024-03-01")
    seen = spark.createDataFrame([(f"{server}/n/0",), ("https://p.in/3",)], "url string")
    new = feeds.new_links(items, seen)
    watched = sorted((r.position, r.url) for r in new.where("name = 'page'").collect())
    assert [u for _, u in watched] == [f"{server}/n/{i}" for i in range(1, 41)] and new.where("name = 'good'").count() == 59


def test_filters_and_columns_reach_the_service(spark, server):
    options = {"url": f"{server}/rest", "table": "cases", "order": "id", "pagesize": "10", "readers": "3"}
    Handler.log.clear()
    df = web.rest_table(spark, options, {"id": "bigint", "date": "string", "company": "string", "slug": "string"}, [["id", "date", "company"], ["id"]])
    got = df.where((F.col("date") >= "2024-06-01") & F.col("company").startswith("c1") & (F.length("company") > 1)).collect()
    assert sorted(r.id for r in got) == [r["id"] for r in ROWS if r["date"] >= "2024-06-01" and r["company"].startswith("c1")] and got[0].slug is None
    assert Handler.log[0][1]["select"] == ["id,date,company,slug"] and Handler.log[1][1]["select"] == ["id,date,company"]
    reads = [a for p, a in Handler.log[2:]]
    assert reads and all(a["date"][-1] == "gte.2024-06-01" and "like.c1*" in a["company"] for a in reads)
    assert sorted(r.id for r in web.rest_table(spark, options, {"id": "bigint"}).collect()) == list(range(95))
    assert web.rest_table(spark, options | {"limit": "25"}, {"id": "bigint"}).count() == 25
    some = web.rest_table(spark, options, {"id": "bigint", "n": "double"}).where(F.col("id").isin(3, 5))
    assert sorted((r.id, r.n) for r in some.collect()) == [(3, 4.5), (5, 7.5)] and Handler.log[-1][1]["id"][-1] == "in.(3,5)"


def test_a_service_that_refuses_or_is_not_there(spark, server):
    assert web.rest_table(spark, {"url": f"{server}/rest", "table": "cases"}, {"slug": "string"}, [["slug"]]).count() == 0
    assert web.rest_table(spark, {"url": "http://127.0.0.1:1", "table": "t"}, {"id": "int"}).count() == 0
