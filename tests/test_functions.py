"""Scalar functions on written-out cases."""

from pyspark.sql import functions as F

from vigil.functions import dates, money, text, urls
from vigil.operators import clustering, state


def one(spark, **columns):
    names = [k for k in columns if not k.startswith("_")]
    df = spark.createDataFrame([tuple(columns[k] for k in names)], ", ".join(f"{k} string" for k in names))
    return df.select(columns["_"].alias("out")).first().out


def test_amount_spellings(spark):
    for s in ("₹5,00,000", "Rs. 5 lakh", "INR 500000", "five lakh", "0.5 million"):
        assert one(spark, s=s, _=money.largest(money.amounts("s")))["value"] == 500_000
    assert one(spark, s="a fee of 500000", _=F.size(money.amounts("s"))) == 0
    assert one(spark, s="€1.2 billion", _=money.largest(money.amounts("s")))["currency"] == "EUR"


def test_dates(spark):
    for s, want in (("2024-01-05", "2024-01-05"), ("5 January 2024", "2024-01-05"), ("Jan 5, 2024", "2024-01-05"), ("05/01/2024", "2024-01-05"), ("March 2024", "2024-03-01"), ("2024", "2024-01-01"), ("soon", "soon"), (None, "")):
        assert one(spark, s=s, _=dates.normalize_date("s")) == want
    assert one(spark, s="soon", _=dates.days_old("s", F.to_date(F.lit("2024-06-30")))) == 30


def test_names(spark):
    assert one(spark, s="Acme Technologies Pvt. Ltd.", _=text.name_key("s")) == "acme"
    assert one(spark, s="The Bank of India Ltd", _=text.entity_key("s")) == "bank india"
    assert one(spark, s=None, a="", _=text.signature("s", "a")) == "unknown"
    assert one(spark, s="Café Déjà Vu Limited", _=text.slug("s")) == "cafe-deja-vu"
    assert one(spark, s="X v. Union", _=text.entity_type("s")) == "case"
    assert one(spark, s="A & B and C/D, E F", _=F.array_join(text.authorities("s"), "|")) == "E F"


def test_urls(spark):
    for s, want in (("https://www.news.example.co.in/a", "example.co.in"), ("http://m.paper.org/x?y", "paper.org"), ("nonsense", ""), (None, "")):
        assert one(spark, s=s, _=urls.registrable_domain("s")) == want
    for href, want in (("/b", "https://h.in/b"), ("c", "https://h.in/a/c"), ("//o.in/x", "https://o.in/x"), ("http://z/q", "http://z/q")):
        assert one(spark, s="https://h.in/a/page.html?q=1", h=href, _=urls.absolute("s", "h")) == want


def test_excerpt_and_markup(spark):
    assert one(spark, s="aa bb Needle cc", n="needle", _=text.excerpt("s", "n", 6)) == "aa bb Needle"[: len("aa bb Needle")]
    assert one(spark, s="<p>a<script>x</p></script><b>c</b>", _=text.visible_text("s")) == "a c"
    assert one(spark, s='say {"a": 1} now', _=text.json_object("s")) == '{"a": 1}'


def test_slugs_pass_over_taken_ones(spark):
    df = spark.createDataFrame([("x", 1), ("x-2", 2), ("x", 3), ("x", 4)], "slug_base string, arrival_idx int")
    got = {(r.slug_base, r.arrival_idx): r.slug for r in clustering.unique_slugs(df).collect()}
    assert len(set(got.values())) == 4 and got["x", 1] == "x" and got["x", 3] == "x-3"


def test_state(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, v string, w int")
    assert sorted(map(tuple, state.upsert(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
    assert sorted(map(tuple, state.upsert(old, new, ["k"], ignore=True).collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert state.delete(old, F.col("w") > 1).count() == 1
    assert state.update(old, F.col("k") == 1, {"v": F.lit("z")}).where("v = 'z'").count() == 1
