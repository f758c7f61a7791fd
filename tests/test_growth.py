"""Cases that larger tables showed: plans that write an expression out too often, cut pages, work that grows faster than its input."""

import math
import random
import time
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vigil.functions import lexicons as L
from vigil.functions import markup
from vigil.functions import text as T
from vigil.operators import dedup
from vigil.plans import catalogue
from vigil.sources import scratch
from vigil.sources.tables import view

SF = "/root/testdata/sf0.001"


def test_unterminated_references_stay():
    page = "<article><h1>a &amp; b &lt;c&gt; d&amp;&amp</h1><p>x&am</p></article>"
    assert markup.structure(page)["text"] == "a & b <c> d&&amp x&am"
    assert markup.structure('<a href="/p?a=1&copy=2&amp;b=3">label</a>')["links"][0]["href"] == "/p?a=1&copy=2&b=3"
    assert markup.structure("<p>&#233;&#xe9;&nosuch; &</p>")["text"] == "éé&nosuch; &"


def test_breakdown_computes_the_age_once(spark):
    plan = catalogue.QUERIES["score_breakdown"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("datediff") <= 2 and plan.count("Generate explode") == 1


def test_folding_equals_decomposition_and_is_fast(spark):
    signs = "".join(chr(c) for c in range(128, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFKD", chr(c)) != chr(c))
    long = "Łódź ﬁne № Ａ İş ㎏ " + "plain words and some é ü " * 2000
    df = spark.createDataFrame([(signs,), (long,), ("",), ("ascii",)] + [(f"{i} {long}",) for i in range(200)], "t string").cache()
    df.count()
    began = time.time()
    got = [(r.t, r.f) for r in df.select("t", T.ascii_fold("t").alias("f")).collect()]
    seconds = time.time() - began
    for t, f in got:
        assert f == unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    assert seconds < 30


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tracked_terms_of_all_cases(spark):
    names = {r.v for r in view(spark, SF, "cases").select(F.lower(F.trim("company")).alias("v")).distinct().collect()}
    assert len(names) > 60 and names <= {r.term for r in catalogue.QUERIES["tracked_terms"](spark, SF).collect()}


def test_pages_come_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    catalogue.QUERIES["page_links"](spark, SF)
    assert int(spark.conf.get(key)) <= 250


def test_documents_are_folded_once_for_all_tokens(spark):
    line = next(x for x in optimized(catalogue.QUERIES["match_document"](spark, SF)).split("\n") if " AS entity_matched" in x)
    assert "[^a-z0-9_]" not in line and "gettimestamp" not in line


def test_case_slugs_fold_each_name_once(spark):
    df = spark.createDataFrame([("", None, "2024-05-06"), ("Ünit Ltd", "Board X", None)], "c string, a string, d string")
    got = df.select(T.case_slug("c", "a", "d").alias("s"))
    assert [r.s for r in got.collect()][0] == "case-case-202405"
    df = spark.read.parquet(f"{SF}/customer.parquet").select(T.case_slug("c_name", "c_mktsegment", "c_name").alias("s"))
    assert optimized(df).count("translate(") == 2


def test_pairs_leave_their_blocks_verified(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_TERMS", 2000)
    r = random.Random(3)
    words = [f"word{k}" for k in range(400)]
    base = [[r.choice(words[: r.choice([20, 100, 400])]) for _ in range(r.choice([2, 5, 30, 200]))] for _ in range(60)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[: len(w) - k], *(r.choice(words) for _ in range(k))]) for w in base for k in (1, 2, 5, 25)] + ["", "the", None, "lone"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:7])], "doc_id long, text string")
    pairs = dedup.near_duplicates(docs, 0.7)
    assert " Join " not in optimized(pairs) and "FlatMapGroupsInArrow" in optimized(pairs)
    first = {}
    for i, t in enumerate(texts):
        if t is not None:
            first.setdefault(t, i)
    bags = {i: Counter(w for w in t.split() if w not in L.STOP_WORDS) for t, i in first.items()}
    bags = {i: b for i, b in bags.items() if b}
    df = Counter(w for b in bags.values() for w in b)
    unit = {}
    for i, b in bags.items():
        v = {w: c * (math.log((1 + len(bags)) / (1 + df[w])) + 1) for w, c in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        unit[i] = {w: x / norm for w, x in v.items()}
    want = {(a, b): s for a in unit for b in unit if a < b and (s := sum(x * unit[b].get(w, 0) for w, x in unit[a].items())) >= 0.7}
    got = {(p.a, p.b): p.similarity for p in pairs.collect()}
    assert got.keys() == want.keys() and len(want) > 100 and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert dedup.near_duplicates(docs.limit(0)).count() == 0


def test_keep_first_joins_no_texts(spark):
    docs = spark.createDataFrame([(4, "fine data board", 1), (2, "fine data board", 2), (7, None, 3), (8, None, 4), (9, "fine data board rule", 5), (5, "court bank", 6)], "doc_id long, text string, k int")
    out = dedup.keep_first(docs.select("doc_id", "text"), 0.7).select("doc_id", "duplicate_of")
    assert not [x for x in optimized(out).split("\n") if " Join " in x and "text#" in x]
    got = {r.doc_id: r.duplicate_of for r in out.collect()}
    assert got == {4: 2, 2: None, 7: None, 8: None, 9: 2, 5: None}


def test_stored_tables_leave_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    was, before = spark.conf.get(scratch.CLEAN_UP, "false"), files()
    table = scratch.stored(spark.range(10000).withColumn("k", F.col("id") % 100).repartition(7, "k"))
    assert spark.conf.get(scratch.CLEAN_UP, "false") == was
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.5)
    assert files() <= before and table.count() == 10000


def test_waves_bound_the_copies_of_a_block():
    for blocks in range(2, 40):
        met = []
        for distances in dedup.waves(blocks):
            pairs = {tuple(sorted((b, (b + d) % blocks))) for d in distances for b in range(blocks)}
            assert max(Counter(b for p in pairs for b in set(p)).values()) <= dedup.COPIES
            met += pairs
        assert sorted(met) == [(a, b) for a in range(blocks) for b in range(a, blocks)]


def test_terms_are_numbered_rarest_first_and_packed_whole(spark):
    texts = [f"board {'court' if k % 3 else 'fine'} lone{k}{' rule' if k < 3 else ''}" for k in range(9)]
    docs = spark.createDataFrame([*enumerate(texts), (20, texts[0]), (21, None), (22, "the")], "doc_id long, text string")
    terms, n = dedup.numbered_terms(docs)
    assert n == 9 and sorted((r.term, r.df) for r in terms.collect()) == [(0, 3), (1, 3), (2, 6), (3, 9)]
    x = np.array([0, 5, 70000, 2**31 - 1, 3])
    assert dedup.unpacked([dedup.packed(x), dedup.packed(x[:2])], [5, 2]).tolist() == [*x, 0, 5]
