"""Artifacts, search and official look-up, and verification summaries."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.functions import lexicons as L
from vigil.operators import search, verification
from vigil.sources import artifacts, scratch


def test_artifacts_are_staged_and_idempotent(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "api" / "cases")
    frame = lambda n, at: spark.createDataFrame([(i, [f"u{i}"], {"a": i}, at) for i in range(n)], "id long, sources array<string>, m map<string,int>, generated_at string")
    assert artifacts.publish(frame(3, "x"), path) == "written" and artifacts.publish(frame(3, "y"), path) == "unchanged"
    assert artifacts.publish(frame(0, "z"), path) == "refused" and spark.read.json(path).count() == 3
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        m.setattr(scratch, "rename", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        artifacts.publish(frame(5, "x"), path)
    assert spark.read.json(path).count() == 3 and artifacts.current(spark, path)["rows"] == 3
    assert artifacts.publish(frame(5, "x"), path) == "written" and spark.read.json(path).count() == 5
    # lost between the two renames: the old folder is put back
    folder = str(tmp_path / "api")
    scratch.rename(spark, path, f"{folder}/_old-cases-lost")
    assert artifacts.current(spark, path)["rows"] == 5 and artifacts.publish(frame(5, "q"), path) == "unchanged"
    told = artifacts.publish_all(spark, folder, {"cases": frame(5, "t"), "bad": spark.range(1).select(F.raise_error(F.lit("no")).alias("x")), "events": frame(2, "t").drop("m")}, {"events": "csv"})
    assert told["cases"] == "unchanged" and told["events"] == "written" and told["bad"].startswith("failed")
    assert sorted(r.sources for r in spark.read.option("header", "true").csv(f"{folder}/events").collect()) == ["u0", "u1"]
    assert not [n for n in scratch.names(spark, folder) if n.startswith("_old")]
    assert artifacts.trace(frame(9, "t"), [F.desc("id")], 4).count() == 4


def bm25(docs, query, k):
    toks = lambda t: [w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 2 and w not in L.STOP_WORDS]
    sets = {u: Counter(toks(t)) for u, t in docs if toks(t)}
    mean = sum(sum(c.values()) for c in sets.values()) / len(sets)
    df = Counter(w for c in sets.values() for w in c)
    score = Counter()
    for w in set(toks(query)) & set(df):
        idf = math.log(1 + (len(sets) - df[w] + 0.5) / (df[w] + 0.5))
        for u, c in sets.items():
            if c[w]:
                score[u] += idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    return sorted(score, key=lambda u: (-round(score[u], 9), u))[:k]


def test_search_equals_brute_force(spark):
    r = random.Random(2)
    words = ["penalty", "bank", "data", "board", "notice", "appeal", "fine", "rare"]
    docs = [(f"https://h{i % 5}.in/{i}", " ".join(r.choice(words[:7]) for _ in range(r.randint(0, 30)))) for i in range(80)] + [("https://h1.in/x", "rare rare word"), ("https://h2.in/n", None)]
    pages = spark.createDataFrame([(u, "t", t) for u, t in docs], "url string, title string, text string")
    queries = [("1", "bank penalty"), ("2", "Rare notice!"), ("3", "unknown"), ("4", ""), ("5", "data data board")]
    index = search.Index(pages, "url", "text")
    got = index.search(spark.createDataFrame(queries, "qid string, query string"), 6).orderBy("qid", "rank").collect()
    for q, text in queries:
        assert [x.doc for x in got if x.qid == q] == bm25(docs, text, 6)
    provider = search.index_provider(pages, 3)
    asked = spark.createDataFrame([("a", "bank", ["h1.in"]), ("b", "rare", [])], "qid string, query string, sites array<string>")
    found = provider(asked).collect()
    assert {x.url.split("/")[2] for x in found if x.qid == "a"} == {"h1.in"} and next(x.url for x in found if x.qid == "b" and x.rank == 1) == "https://h1.in/x"
    assert search.index_provider(pages.limit(0))(asked).count() == 0


def test_postings_are_dealt_by_page_and_only_the_asked_ones(spark, monkeypatch):
    r = random.Random(5)
    words = ["penalty", "bank", "data", "board", "notice", "appeal", "fine"]
    rows = [(i % 70, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(90)] + [(None, "bank data"), (3, None)]
    docs = spark.createDataFrame(rows, "doc long, text string")
    asked = spark.createDataFrame([(i, " ".join(r.sample(words, 2))) for i in range(8)] + [(8, "unknown")], "qid long, query string")
    monkeypatch.setattr(search, "TASK_CHARS", 500)
    monkeypatch.setattr(search, "TASK_SCORES", 50)
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0, raising=False)
    index = search.Index(docs, "doc", "text")
    joined = [tuple(x) for x in index.search(asked, 4).orderBy("qid", "rank").collect()]
    monkeypatch.setattr(search, "BROADCAST_TERMS", 100, raising=False)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = index.search(asked, 4)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = [tuple(x) for x in out.orderBy("qid", "rank").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" not in plan and "hashpartitioning(term" not in plan and "hashpartitioning(qid#" in plan
    assert "hashpartitioning" in plan and plan.count("hashpartitioning(") == 1  # the best of each query; the scores stay where their page is
    assert [x[:3] for x in got] == [x[:3] for x in joined] and len(got) == 32


def test_a_chain_asks_the_next_provider_for_what_is_left(spark):
    asked = []

    def provider(name, hits):
        def run(queries):
            asked.append((name, sorted(r.qid for r in queries.collect())))
            return queries.where(F.col("qid").isin(hits)).select("qid", F.lit(1).alias("rank"), F.lit(f"http://{name}/u").alias("url"), F.lit("t").alias("title"), F.lit("").alias("summary"))

        return run

    queries = spark.createDataFrame([("1", "a", []), ("2", "b", []), ("3", "c", [])], "qid string, query string, sites array<string>")
    out = search.chain([provider("one", ["1"]), provider("two", ["1", "2"])])(queries)
    assert sorted((r.qid, r.url) for r in out.collect()) == [("1", "http://one/u"), ("2", "http://two/u")]
    assert asked[0] == ("one", ["1", "2", "3"]) and asked[-1] == ("two", ["2", "3"])
    flat = search.sweep(out, queries.select("qid", F.col("qid").cast("int").alias("order"))).collect()
    assert sorted((r.source, r.url) for r in flat) == [("one", "http://one/u"), ("two", "http://two/u")]


def test_cases_without_a_trusted_url_find_their_document(spark):
    order = "The Reserve Bank imposed a penalty of Rs 5 crore on Acme Robotics Limited on 2024-03-01 for lapses in its handling of customer data, after an inquiry."
    pages = spark.createDataFrame(
        [("https://www.rbi.org.in/o/1", "order", order), ("https://rbi.org.in/o/2", "other", "A notice about coins and notes in circulation."), ("https://blog.example/acme", "blog", order * 3), ("https://sebi.gov.in/x", "s", order)],
        "url string, title string, text string",
    )
    cases = spark.createDataFrame(
        [("1", "Acme Robotics Limited", "Reserve Bank of India", "penalty", "Rs 5 crore", "2024-03-01", "https://news.example/a", "", ["https://press.example/b"]), ("2", "Nobody Known", "Reserve Bank of India", "", "", "", "", "", None), ("3", "Acme Robotics", "", "", "Rs 9 crore", "2020-01-01", "https://news.example/c", "", ["https://sebi.gov.in/x"])],
        "id string, company string, authority string, keywords string, penalty string, date string, source_url string, official_source_url string, listed array<string>",
    )
    found = search.official_sources(cases.where("id <> '3'"), search.index_provider(pages))
    assert [(r.id, r.official_url) for r in found.collect()] == [("1", "https://www.rbi.org.in/o/1")]
    docs = pages.select("url", F.col("text").alias("document"))
    out = verification.verify(cases, docs, L.TRUSTED_DOMAINS, "listed", found)
    got = {r.id: r for r in verification.summaries(out).collect()}
    assert got["1"].verified and got["1"].trust_tier == "primary" and got["1"].strength == "strong" and got["1"].independent_sources == 2 and "Acme" in got["1"].excerpt
    assert (got["2"].strength, got["2"].trust_tier, got["2"].reasons, got["2"].excerpt) == ("none", "ai", ["no_official_source_found"], "")
    # a listed source is a trusted one, but does not bear the claim out
    assert (got["3"].official_url, got["3"].verified, got["3"].trust_tier) == ("https://sebi.gov.in/x", False, "press") and "amount_not_found" in got["3"].reasons
