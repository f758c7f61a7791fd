"""Durable keyed tables, and sweeps with seen set and backlog, against replays."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import reports
from vigil.sources import keyed, scratch
from vigil.streaming.sweep import FIELDS, Sweeper


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return keyed.KeyedTable(spark, str(tmp_path / "t"), ["k"], "k long, a string, n int", buckets=4)


def test_merges_persist_and_touch_their_buckets_alone(spark, table):
    frame = lambda r: spark.createDataFrame(r, "k long, a string, n int")
    assert table.read().count() == 0 and not table.upsert(frame([]))
    assert table.upsert(frame([(k, f"v{k}", k) for k in range(20)]))
    before = table.manifest()["buckets"]
    assert table.upsert(frame([(3, None, 33), (100, "new", None)]))
    after = table.manifest()["buckets"]
    assert 1 <= sum(before.get(b) != after.get(b) for b in after) <= 2
    got = dict((r[0], r[1:]) for r in rows(table))
    assert got[3] == ("v3", 33) and got[100] == ("new", None) and len(got) == 21
    table.upsert(frame([(3, "late", 1), (200, "x", 1)]), ignore=True)
    got = dict((r[0], r[1:]) for r in rows(table))
    assert got[3] == ("v3", 33) and got[200] == ("x", 1)
    assert table.update(F.col("k") == 5, {"a": F.lit("patched")}) and not table.update(F.col("k") == -1, {"a": F.lit("")})
    assert table.delete(F.col("n") > 10)
    got = dict((r[0], r[1:]) for r in rows(table))
    assert got[5] == ("patched", 5) and 3 not in got and 15 not in got and got[100] == ("new", None)
    assert dict((r[0], r[1:]) for r in table.read(1).select("k", "a", "n").collect())[3] == ("v3", 3)  # earlier versions stay readable
    assert table.vacuum(1) > 0 and len(rows(table)) == len(got)
    with pytest.raises(ValueError, match="null"):
        table.upsert(frame([(None, "x", 1)]))


def test_all_rows_of_a_bucket_may_go(spark, table):
    table.upsert(spark.createDataFrame([(1, "a", 1)], "k long, a string, n int"))
    assert table.delete(F.col("k") == 1) and table.read().count() == 0
    table.upsert(spark.createDataFrame([(1, "b", 1)], "k long, a string, n int"))
    assert rows(table) == [(1, "b", 1)]


def test_lost_and_repeated_writes_change_nothing(spark, table, monkeypatch):
    frame = spark.createDataFrame([(1, "a", 1)], "k long, a string, n int")
    assert table.upsert(frame, name="one") and not table.upsert(frame.withColumn("n", F.lit(9)), name="one")
    assert rows(table) == [(1, "a", 1)]

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        m.setattr(keyed.KeyedTable, "_commit", lost)
        table.upsert(frame.withColumn("n", F.lit(2)), name="two")
    assert rows(table) == [(1, "a", 1)] and table.version() == 1
    assert table.upsert(frame.withColumn("n", F.lit(2)), name="two") and rows(table) == [(1, "a", 2)]
    # another writer commits between a writer's start and its commit
    base, manifest = table._start(None)
    table.upsert(frame.withColumn("n", F.lit(3)))
    with pytest.raises(keyed.Conflict):
        table._commit(base, manifest)
    assert rows(table) == [(1, "a", 3)]


def test_a_graph_persisted_twice_is_the_same(spark, tmp_path, monkeypatch):
    store = keyed.Store(spark, str(tmp_path / "s"), 4)
    entities = spark.createDataFrame([("k1", "s1", "One", "company", ["o"]), ("k2", "s2", "Two", "court", [])], keyed.ENTITIES)
    events = spark.createDataFrame([(str(i), f"e{i}", f"e{i}", "t", "2024-01-01", "press", 1.0, "x", "y") for i in range(9)], keyed.EVENTS)
    links = spark.createDataFrame([(str(i), "k1", "subject") for i in range(9)] * 2, keyed.LINKS)
    state = lambda: [rows(t) for t in (store.entities, store.events, store.links)]
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(store.links, "upsert", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        store.persist_graph(entities, events, links, name="run-1")
    store.persist_graph(entities, events, links, name="run-1")
    first = state()
    store.persist_graph(entities, events, links)
    assert state() == first and [len(x) for x in first] == [2, 9, 9]
    when = datetime.datetime(2024, 1, 1)
    store.record_stories(spark.createDataFrame([("u", "s", "h", 3, "scanned", when)], keyed.STORIES))
    store.record_stories(spark.createDataFrame([("u", "s", "other", 9, "alerted", when)], keyed.STORIES))
    assert [r.headline for r in store.stories.read().collect()] == ["h"]
    evidence = spark.createDataFrame([("a", "u", "h1", "x", "weak"), ("a", "v", "h2", "y", "strong")], keyed.EVIDENCE)
    store.record_evidence(evidence)
    store.record_evidence(evidence.where("official_url = 'u'").withColumn("strength", F.lit("strong")))
    assert {(r.official_url, r.strength) for r in store.evidence.read().collect()} == {("u", "strong"), ("v", "strong")}


def judge(df):
    """A score and a verdict from the title alone."""
    score = F.length("title") % 7
    return df.withColumns({"keep": ~F.contains("title", F.lit("noise")), "priority": F.length("title") % 3, "score": score})


def replay(batches, cap, size, age, days):
    """Python form of the sweep: [(epoch, url, carried)] in order."""
    seen, backlog, out = set(), [], []
    for epoch, batch in enumerate(batches):
        first = {}
        for it in batch:
            if it["url"] and it["url"] not in seen:
                first.setdefault(it["url"], it)
        kept = [i for i in first.values() if "noise" not in i["title"]]
        kept.sort(key=lambda i: -(len(i["title"]) % 3))
        urls = {i["url"] for i in kept}
        carried = [i for i, at in backlog if days[epoch] - at <= age and i["url"] not in seen and i["url"] not in urls]
        pool = [(i, False) for i in kept] + [(i, True) for i in carried]
        pool.sort(key=lambda x: -(len(x[0]["title"]) % 7))
        out += [(epoch, i["url"], c) for i, c in pool[:cap]]
        seen |= {i["url"] for i, _ in pool[:cap]}
        backlog = [(i, days[epoch]) for i, _ in pool[cap:]][:size]
    return out


@pytest.mark.parametrize("gap", [1, 30])
def test_sweeps_equal_replay(spark, tmp_path, gap):
    r = random.Random(8)
    batches = []
    for b in range(3):
        batches.append([{"url": r.choice(["", f"u{r.randint(0, 40)}"]), "source": "s", "title": "t" * r.randint(1, 20) + r.choice(["", "", " noise"]), "summary": "x", "published": "", "arrival_idx": 100 * b + k} for k in range(25)])
    days = [0, 1, 1 + gap]
    schema = ", ".join(f"{f} string" for f in FIELDS) + ", arrival_idx long"
    for b in batches:
        spark.createDataFrame([[i[f] for f in [*FIELDS, "arrival_idx"]] for i in b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sweeper = Sweeper(spark, str(tmp_path / "state"), judge, cap=4, size=12)
    now = lambda e: F.lit(datetime.datetime(2024, 1, 1) + datetime.timedelta(days=days[e]))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sweeper.attach(stream, now).awaitTermination()
    got = [(x.epoch, x.url, x.carried) for x in sweeper.results().orderBy("epoch", "rank").collect()]
    want = replay(batches, 4, 12, 21, days)
    assert got == want and any(c for *_, c in want) == (gap == 1 or any(c for e, _, c in want if e == 1))
    again = sweeper.sweep(spark.createDataFrame([[i[f] for f in [*FIELDS, "arrival_idx"]] for i in batches[2]], schema), 2, now(2))
    assert [x.url for x in again.orderBy("rank").collect()] == [u for e, u, _ in want if e == 2]
    assert scratch.exists(spark, str(tmp_path / "state"))


def test_oldest_evidence_of_equal_rows_is_the_strongest(spark):
    rows = [(k, f"u{k}", s, 1) for k in range(20) for s in (["weak", "strong", "moderate"] if k % 2 else ["moderate", "weak"])] + [(0, "u0", "strong", 2), (0, "u1", "strong", 1)]
    for order in (rows, rows[::-1]):
        got = reports.oldest_evidence(spark.createDataFrame(order, "action_id long, url string, strength string, arrival int").repartition(3))
        assert sorted(map(tuple, got.collect())) == [(k, f"u{k}", "strong" if k % 2 else "moderate") for k in range(20)]
