"""Entity resolution with feedback, slugs and related entities against sequential replays."""

import random
from collections import Counter
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vigil.functions import lexicons as L
from vigil.functions import text as T
from vigil.operators import clustering, graph, resolver


def slug(text, words):
    plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
    return "-".join([w for w in re.sub("[^a-z0-9]+", " ", plain).split() if w not in L.SLUG_STOP][:words]) or "case"


def replay(names, threshold=0.72):
    """(norm -> key, entities, aliases) by the sequential rule; normal forms are given."""
    tokens = lambda n: {t for t in n.split() if len(t) > 2}
    norm = lambda n: " ".join(w for w in re.sub(L.SUFFIXES_ENTITY, " ", re.sub("[^a-z0-9 ]+", " ", n.lower())).split() if w not in L.ENTITY_STOP)
    alias, canonical, entities, aliases, slugs = {}, {}, {}, set(), set()
    for c, vs in L.ALIAS_SEEDS.items():
        canonical[norm(c)] = c
        for v in [c, *vs]:
            alias[norm(v)] = norm(c)
    for raw in names:
        if raw is None or not norm(raw):
            continue
        n = norm(raw)
        key = alias.get(n)
        if key is None:
            best, score = None, 0.0
            for k in entities:
                a, b = tokens(n), tokens(k)
                s = len(a & b) / len(a | b) if a and b else 0.0
                if s > score:
                    best, score = k, s
            key = best if best and score >= threshold else n
        if key not in entities:
            name = canonical.get(key, raw.strip())
            base, k = slug(name, 5), 2
            s = base
            while s in slugs:
                s, k = f"{base}-{k}", k + 1
            slugs.add(s)
            entities[key] = (name, s)
        if n != key:
            aliases.add((key, raw.strip()))
        alias[n] = key
    return alias, entities, aliases


def company_names(seed, n=250):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "zeta", "iota"]
    out = [" ".join(r.sample(words, r.randint(1, 7))) + r.choice(["", "", " Pvt Ltd", " Inc.", " of X1"]) for _ in range(n)]
    out += ["Meta", "facebook india", "META  Platforms", "Reserve Bank", "RBI", "meta platforms asia", None, " ", "Ltd", "x1", "x1 y2", "Amex", "American Express Bank", "Star Health Allied Insurance India"]
    r.shuffle(out)
    return [w.title() if w and r.random() < 0.5 else w for w in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_resolver_equals_replay(spark, seed):
    names = company_names(seed)
    df = spark.createDataFrame(list(enumerate(names)), "order long, name string")
    resolved, entities, aliases = resolver.resolve(df)
    alias, want, variants = replay(names)
    got = {r.norm: r.key for r in resolved.collect()}
    assert got == {n: alias[n] for n in got} and len(got) > 100
    rows = entities.collect()
    assert {r.key: (r.name, r.slug) for r in rows} == want
    assert {(r.key, r.alias) for r in aliases.collect()} == variants and len(variants) > 20
    types = {r.name: r.entity_type for r in rows}
    assert types["Meta Platforms"] == "company" and types["Reserve Bank of India"] == "regulator"


def test_resolver_of_no_names(spark):
    for part in resolver.resolve(spark.createDataFrame([], "order long, name string")):
        assert part.count() == 0


@pytest.mark.parametrize("word", ["Łódź Şirket İş", "½ ﬁne №5 ™", "Ünïcode — ＡＢＣ", "日本", "", "of the", "𝐁𝐨𝐥𝐝 ǆ"])
def test_slug_is_compatible_ascii(spark, word):
    assert spark.range(1).select(T.slug(F.lit(word), 6).alias("s")).first().s == slug(word, 6)


def test_slugs_are_distinct_and_stored_ones_stay(spark):
    r = random.Random(4)
    bases = ["a"] * 200 + ["b", "a-2", "a-2", "a-4", "a-02", "a-2-2", "b-3", "b", "b", "b"]
    r.shuffle(bases)
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bases)], "arrival_idx long, slug_base string")
    once = {x.arrival_idx: x.slug for x in clustering.unique_slugs(df).collect()}
    assert len(once) == len(bases) == len(set(once.values()))
    firsts = {}
    for i, b in enumerate(bases):
        firsts.setdefault(b, i)
    assert all(once[i] == b for b, i in firsts.items())
    taken, want = set(bases), {}
    for i, b in enumerate(bases):
        k = 2
        if firsts[b] != i:
            while f"{b}-{k}" in taken:
                k += 1
        want[i] = b if firsts[b] == i else f"{b}-{k}"
        taken.add(want[i])
    assert once == want
    # a second run over the stored slugs and new rows
    again = spark.createDataFrame([(i, b, once[i] if i % 3 else None) for i, b in enumerate(bases)], "arrival_idx long, slug_base string, slug_stored string")
    second = {x.arrival_idx: x.slug for x in clustering.unique_slugs(again, stored="slug_stored").collect()}
    assert all(second[i] == once[i] for i in once if i % 3) and len(set(second.values())) == len(bases)


def test_related_entities_in_blocks(spark, monkeypatch):
    r = random.Random(3)
    links = [(e, f"n{r.randint(0, 30)}") for e in range(20) for _ in range(6)] + [(99, f"n{k}") for k in range(31)]
    df = spark.createDataFrame(links, "event_id long, entity string")
    whole = sorted(map(str, graph.related_entities(df, 5).collect()))
    monkeypatch.setattr(graph, "BLOCK", 4)
    assert sorted(map(str, graph.related_entities(df, 5).collect())) == whole


def test_only_listed_sections_are_cited(spark):
    texts = ["Section 21 and Section 9", "Sec. 8(5) DPDP Act", "IT Act Section 43A", "section 33, s. 33, sec 27", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.citations("t").alias("c")).collect()
    assert [r.c for r in rows] == [["9"], ["8"], [], ["33", "27"], []]


def test_related_entities_have_tasks_by_their_pairs(spark, monkeypatch):
    links = spark.createDataFrame([(e, f"n{(e * k) % 37}") for e in range(40) for k in range(9)] + [(None, "n1"), (3, None)], "event_id long, entity string")
    seen = spark.createDataFrame([(f"n{k}", 37 - k) for k in range(37)], "entity string, first_seen int")
    by_event, shared = {}, Counter()
    for e, n in links.where("event_id IS NOT NULL AND entity IS NOT NULL").collect():
        by_event.setdefault(e, set()).add(n)
    for of in by_event.values():
        shared.update((a, b) for a in of for b in of if a != b)
    monkeypatch.setattr(graph, "TASK_PAIRS", 100)
    pairs = sum(9 * 8 for _ in by_event)  # repeated links count too
    for block, given in ((1000, None), (1000, seen), (4, None), (4, seen)):
        monkeypatch.setattr(graph, "BLOCK", block)
        out = graph.related_entities(links, 5, given)
        assert out.rdd.getNumPartitions() >= pairs // 100  # 4 by the session
        want = set()
        for a in {a for a, _ in shared}:
            mine = sorted((-n, 37 - int(b[1:]) if given is not None else 0, b) for (x, b), n in shared.items() if x == a)[:5]
            want |= {(a, b, -n, i + 1) for i, (n, _, b) in enumerate(mine)}
        assert {tuple(r) for r in out.collect()} == want
