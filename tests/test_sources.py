"""Readers and writers on small files."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators import insights
from vigil.sources import feeds


def test_rss(spark, tmp_path):
    item = "<item><title>A  {i}</title><link>https://h/{i}</link><description>&lt;p&gt;x&lt;/p&gt;</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>"
    (tmp_path / "f.xml").write_text("<rss><channel>" + "".join(item.format(i=i) for i in range(5)) + "<item><title></title><link>x</link></item></channel></rss>")
    got = feeds.rss(spark, str(tmp_path / "f.xml"), 3).orderBy("arrival_idx").collect()
    assert [r.title for r in got] == ["A 0", "A 1", "A 2"] and got[0].published == "2024-01-01" and got[0].summary == "x"


def test_links(spark):
    html = '<a href="/a">A long enough title</a><a href="b.html">Another <b>long</b> title</a><a href="mailto:x">Mail to somebody now</a><a href="/a">A long enough title</a><a href="/c">short</a>'
    pages = spark.createDataFrame([("https://h.in/d/p.html", html), ("https://n.in", None)], "url string, html string")
    assert sorted((r.link, r.title) for r in feeds.page_links(pages).collect()) == [("https://h.in/a", "A long enough title"), ("https://h.in/d/b.html", "Another long title")]


def test_snapshot(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"sections": {"x": [{"id": "1"}, {"id": "2"}], "y": []}}')
    rows = feeds.snapshot(spark, str(tmp_path / "s.json"), T.StructType([T.StructField("id", T.StringType())]))
    assert sorted(map(tuple, rows.collect())) == [("1", "x"), ("2", "x")]
    out = str(tmp_path / "out")
    assert feeds.write_snapshot(rows, out) and not feeds.write_snapshot(rows, out) and not feeds.write_snapshot(rows.limit(0), out)
    assert feeds.first_filled([lambda: rows.limit(0), lambda: rows]).count() == 2
    assert feeds.existing_columns(rows, {"id": "int", "new": "string"}).collect()[0].new is None


def test_fallback(spark):
    a = spark.createDataFrame([("s", "u", True, True)], "source string, url string, is_primary boolean, always_relevant boolean")
    b = a.withColumn("source", F.lit("t"))
    health = spark.createDataFrame([("t", "error"), ("s", "ok")], "source string, status string")
    got = {r.source: r.is_primary for r in feeds.with_fallback(a, b, health).collect()}
    assert got == {"s": True, "t": False}


def test_insights(spark):
    names = spark.createDataFrame([(1, "Acme Robotics Pvt Ltd", ["Data-Acme/Labs"]), (2, "Bank of India", None), (3, "Later Firm", None)], "at int, name string, aliases array<string>")
    assert {r.term for r in insights.tracked_terms(names, "at", 2).collect()} == {"acme robotics pvt ltd", "acme", "acme robotics", "data-acme/labs", "acme labs", "bank of india"}
    files = spark.createDataFrame([("u", "User-agent: *\nDisallow: /x\nSitemap: y")], "url string, body string")
    r = insights.robots(files).first()
    assert (r.agents, r.disallowed, r.sitemap) == (["*"], ["/x"], True)
    c = spark.createDataFrame([(1, 2.0, "a", 1), (2, 3.0, "a", 2)], "id int, penalty_amount_inr double, authority string, arrival_idx int")
    assert "a (2)" in insights.brief(c, "2024-W01").first().body
    log = spark.createDataFrame([(2, "discard", "t2"), (1, "verify", "t1")], "decided_at int, action string, title string")
    assert insights.few_shot(log).first().block == "CASE: t1\nNOT A CASE: t2"
    t = spark.createDataFrame([("x" * 300, True, False, True), ("", True, False, True)], "text string, extracted boolean, false_positive boolean, verified boolean")
    assert [r.outcome for r in insights.deep_trace(t).collect()] == ["verified", "unfetched"]
