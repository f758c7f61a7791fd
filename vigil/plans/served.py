"""Registered queries over resolver, pages, feeds, persisted tables and stateful streams."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import markup
from ..functions import text as T
from ..operators import events, graph, insights, prefilter, publish, reports, resolver, scoring, search
from ..sources import feeds, scratch
from ..sources.keyed import KeyedTable
from ..sources.tables import table, view
from ..streaming import rolling
from ..streaming.sweep import FIELDS, Sweeper
from .catalogue import ALWAYS, JUDGED, PRIMARY, TIER, TRACKED, as_of, entity_sql, judged, lst, query, slug_sql, sq, tiered

# --- entities, resolved in order with feedback ---
# names of seven tokens, of which near ones share six, and variants of curated entities among them
_RAW = "CASE p_partkey % 50 WHEN 7 THEN 'Meta India' WHEN 9 THEN 'RBI' WHEN 11 THEN ' Facebook' WHEN 13 THEN 'Reserve Bank of India' ELSE concat('Trading House Office ', p_name, ' ', p_type, ' ', p_brand, CASE p_partkey % 3 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN '' ELSE ' Inc.' END) END"
_SEEDED = ", ".join(f"({k}, '{v.replace(chr(39), chr(39) * 2)}', '{c}')" for k, (c, vs) in enumerate(L.ALIAS_SEEDS.items()) for v in [c, *vs])
_ROUNDS = 12


def _resolver_sql() -> str:
    """The sequential rule by rounds: a token set leads if all earlier sets near it are settled and none leads."""
    toks = "list_sort(list_distinct(list_filter(string_split(norm, ' '), lambda w: len(w) > 2)))"
    parts = [
        f"s0 AS (SELECT {entity_sql('variant')} AS norm, {entity_sql('canonical')} AS key, canonical, ord FROM (VALUES {_SEEDED}) AS v(ord, variant, canonical))",
        "s AS (SELECT norm, max_by(key, ord) AS key, max_by(canonical, ord) AS canonical FROM s0 GROUP BY norm)",
        f"raw AS (SELECT p_partkey AS pos, trim(raw) AS raw, {entity_sql('raw')} AS norm FROM (SELECT p_partkey, {_RAW} AS raw FROM part))",
        "n AS (SELECT norm, min(pos) AS pos, min_by(raw, pos) AS raw FROM raw WHERE norm <> '' GROUP BY norm)",
        f"f AS (SELECT norm, pos, raw, {toks} AS toks FROM n WHERE norm NOT IN (SELECT norm FROM s))",
        "g AS (SELECT toks, min(pos) AS pos, min_by(norm, pos) AS norm FROM f WHERE len(toks) > 0 GROUP BY toks)",
        f"c AS (SELECT key, canonical, min(pos) AS pos, any_value(t) AS toks FROM (SELECT s.key, s.canonical, n.pos, {toks.replace('norm', 's.key')} AS t FROM n JOIN s USING (norm)) GROUP BY key, canonical)",
        "k AS (SELECT toks, pos, norm AS entity, false AS curated FROM g UNION ALL SELECT toks, pos, key, true FROM c)",
        "m AS (SELECT g.toks AS a, k.toks AS b, k.pos AS made, k.entity, k.curated, g.pos AS own, len(list_intersect(g.toks, k.toks)) / len(list_distinct(list_concat(g.toks, k.toks))) AS similarity FROM g, k)",
        "p AS (SELECT * FROM m WHERE similarity >= 0.72)",
        "e AS (SELECT a, b, curated FROM p WHERE made < own)",
        "r0 AS (SELECT toks, CAST(NULL AS BOOLEAN) AS leads FROM g)",
    ]
    for i in range(_ROUNDS):
        parts.append(
            f"r{i + 1} AS (SELECT g.toks, CASE WHEN near THEN false WHEN NOT coalesce(open, false) THEN true END AS leads FROM g LEFT JOIN (SELECT a, bool_or(coalesce(l, false)) AS near, bool_or(l IS NULL) AS open "
            f"FROM (SELECT e.a, e.curated OR r{i}.leads AS l FROM e LEFT JOIN r{i} ON e.b = r{i}.toks) GROUP BY a) x ON g.toks = x.a)"
        )
    parts += [
        f"l AS (SELECT p.* FROM p LEFT JOIN r{_ROUNDS} r ON p.b = r.toks WHERE p.curated OR r.leads)",
        "h AS (SELECT f.norm, first(l.entity ORDER BY l.similarity DESC, l.made) AS key FROM f JOIN l ON f.toks = l.a AND l.made <= f.pos GROUP BY f.norm)",
        "q AS (SELECT n.norm, n.pos, n.raw, coalesce(s.key, h.key, n.norm) AS key, s.canonical FROM n LEFT JOIN s USING (norm) LEFT JOIN h USING (norm))",
        "ent AS (SELECT key, coalesce(max(canonical), max(raw) FILTER (norm = key)) AS name, min(pos) AS first_seen FROM q GROUP BY key)",
        f"named AS (SELECT *, {slug_sql('name', 5)} AS base FROM ent)",
    ]
    return "WITH " + ",\n".join(parts)


_RESOLVED = _resolver_sql()
_RAW_TYPES = "CASE WHEN name LIKE '%Reserve Bank%' THEN 'regulator' ELSE 'company' END"


def _resolved(spark, sf):
    return resolver.resolve(table(spark, sf, "part").select(F.expr(_RAW).alias("name"), F.col("p_partkey").alias("order")))


@query("entity_resolution", f"{_RESOLVED} SELECT key, name, {_RAW_TYPES} AS entity_type, CASE WHEN row_number() OVER w = 1 THEN base ELSE concat(base, '-', row_number() OVER w) END AS slug, first_seen FROM named WINDOW w AS (PARTITION BY base ORDER BY first_seen)")
def _(spark, sf):
    return _resolved(spark, sf)[1]


@query("entity_aliases", f"{_RESOLVED} SELECT DISTINCT q.key, raw.raw AS alias FROM raw JOIN q USING (norm) WHERE raw.norm <> q.key")
def _(spark, sf):
    return _resolved(spark, sf)[2]


# --- pages by structure ---
_IN_ARTICLE = r"regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1)"
_PLAIN = f"replace(replace(replace(replace({{x}}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("article_text", f"SELECT page_id, left({sq(_PLAIN.format(x='regexp_replace(' + _IN_ARTICLE + ', $q$(?s)<[^>]+>$q$, $q$ $q$, $q$g$q$)'))}, 12000) AS text FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.article(markup.page("html")["text"]).alias("text"))


_HREFS = "unnest(range(len(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)))) AS position, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) AS label"


@query(
    "page_links",
    f"""WITH a AS (SELECT url, {_HREFS} FROM pages), b AS (SELECT url, position, {sq(_PLAIN.format(x='label'))} AS title, CASE WHEN href LIKE 'http%' THEN href ELSE concat(regexp_extract(url, '^[a-z]+://[^/?#]*'), href) END AS link FROM a WHERE href <> ''),
  c AS (SELECT link, first(url ORDER BY url, position, title) AS url, first(position ORDER BY url, position, title) AS position, first(title ORDER BY url, position, title) AS title FROM b WHERE len(title) >= 3 GROUP BY link)
  SELECT url, CAST(position AS INT) AS position, title, link FROM c QUALIFY row_number() OVER (PARTITION BY url ORDER BY position) <= 40""",
)
def _(spark, sf):
    return feeds.page_links(table(spark, sf, "pages").select("url", "html"), least=3)


_NO_CODE = "regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g')"
_SEEN_TEXT = sq(f"regexp_replace({_NO_CODE}, '<[^>]+>', ' ', 'g')")


@query(
    "crawler_view",
    f"SELECT page_id, CAST(length(html) AS INT) AS html_chars, CAST(strlen(html) AS INT) AS html_bytes, CAST(length({_SEEN_TEXT}) AS INT) AS visible_text_chars, array_to_string(regexp_extract_all({_NO_CODE}, '(?s)<h[12][^>]*>(.*?)</h[12]>', 1)[1:6], '|') AS headings, left({_SEEN_TEXT}, 600) AS text_preview, contains(html, 'fetch(') AS js_dependent FROM pages",
)
def _(spark, sf):
    v = table(spark, sf, "pages").select("page_id", markup.crawler_view("html").alias("v"))
    return v.select("page_id", "v.html_chars", "v.html_bytes", "v.visible_text_chars", F.array_join("v.headings", "|").alias("headings"), "v.text_preview", "v.js_dependent")


# --- feeds: a document of each page, of which some break off, are empty, or can't be had ---
def _feed(k: int) -> str:
    day = "concat('Mon, ', lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0'), ' Jan 2024 23:30:00 -0500')" if k % 2 else "concat('2024-02-', lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0'), 'T10:00:00Z')"
    return f"concat('<item><title>Notice  {k} of ', CAST(page_id AS STRING), '</title><link>https://feed.example/', CAST(page_id AS STRING), '/{k}</link><pubDate>', {day}, '</pubDate></item>')"


_FEED = f"CASE WHEN page_id % 13 = 0 THEN '<rss><channel></channel></rss>' WHEN page_id % 7 = 0 THEN concat('<rss><channel>', {_feed(0)}, {_feed(1)}, '<item><title>broken & off') ELSE concat('<rss><channel>', {_feed(0)}, {_feed(1)}, {_feed(2)}, '</channel></rss>') END"


def _fetched(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("feed-"), F.col("page_id").cast("string")).alias("name"), F.col("url"))
    p = p.withColumns({"kind": F.lit("rss"), "domain": F.when(F.col("page_id") % 2 == 0, "feed.example").otherwise(""), "selector": F.lit("a[href]"), "status": F.when(F.col("page_id") % 11 == 0, "blocked").otherwise("ok"), "content": F.expr(_FEED).cast("binary")})
    return feeds.parsed(p)


_COUNT = "CASE WHEN page_id % 11 = 0 OR page_id % 13 = 0 THEN 0 WHEN page_id % 7 = 0 THEN 2 ELSE 3 END"


@query("feed_health", f"SELECT concat('feed-', page_id) AS source, CASE WHEN page_id % 11 = 0 THEN 'blocked' WHEN page_id % 13 = 0 THEN 'empty' ELSE 'ok' END AS status, {_COUNT} AS items FROM pages")
def _(spark, sf):
    return _fetched(spark, sf).select(F.col("name").alias("source"), "status", F.size("entries").alias("items"))


@query(
    "feed_items",
    f"""SELECT concat('feed-', page_id) AS feed, CAST(k AS INT) AS position, concat('Notice ', k, ' of ', page_id) AS title, concat('https://feed.example/', page_id, '/', k) AS url, CASE WHEN page_id % 2 = 0 THEN 'feed.example' ELSE concat('feed-', page_id) END AS source,
  CASE WHEN k % 2 = 1 THEN CAST(CAST(DATE '2024-01-01' + CAST(page_id % 28 + 1 AS INT) AS DATE) AS VARCHAR) ELSE CAST(CAST(DATE '2024-01-31' + CAST(page_id % 28 + 1 AS INT) AS DATE) AS VARCHAR) END AS published
  FROM (SELECT page_id, unnest(range({_COUNT})) AS k FROM pages)""",
)
def _(spark, sf):
    rows = _fetched(spark, sf).select(F.col("name").alias("feed"), F.explode("entries").alias("e"))
    return rows.select("feed", "e.position", "e.title", "e.url", "e.source", "e.published")


# --- state that persists ---
def _place(spark, name):
    return f"{scratch.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "persisted_merges",
    "WITH a AS (SELECT id, company, outcome, 1 AS n FROM cases), b AS (SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE 'patched' END AS outcome FROM cases WHERE id % 3 = 0 UNION ALL SELECT -id - 1, 'new' FROM cases WHERE id % 5 = 0) "
    "SELECT coalesce(a.id, b.id) AS id, company, coalesce(b.outcome, a.outcome) AS outcome, CASE WHEN coalesce(a.id, b.id) % 4 = 1 THEN 2 ELSE coalesce(n, 0) END AS n FROM a FULL JOIN b ON a.id = b.id WHERE NOT (coalesce(a.id, b.id) % 7 = 1)",
)
def _(spark, sf):
    c = view(spark, sf, "cases").select("id", "company", "outcome", F.lit(1).alias("n"))
    t = KeyedTable(spark, _place(spark, "cases"), ["id"], "id bigint, company string, outcome string, n int", 8)
    t.upsert(c, name="first")
    t.upsert(c, name="first")  # a repeated write is none
    changed = c.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 != 0, "patched").alias("outcome"))
    added = c.where("id % 5 = 0").select((-F.col("id") - 1).alias("id"), F.lit("new").alias("outcome"))
    t.upsert(changed.unionByName(added))
    t.update(F.col("id") % 4 == 1, {"n": F.lit(2)})
    t.delete(F.col("id") % 7 == 1)
    return t.read().withColumn("n", F.coalesce("n", F.lit(0)))


@query("rolling_near_duplicates")
def _(spark, sf):
    d = rolling.RollingDeduplicator(spark, _place(spark, "rolling"))
    stream = spark.readStream.schema(table(spark, sf, "documents").schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf}/documents.parquet")
    d.attach(stream, "doc_id", "doc_id", "text").awaitTermination()
    return d.results().select(F.col("id").alias("doc_id"), "is_duplicate", "duplicate_of", F.round("similarity", 6).alias("similarity"))


@query("sweep_candidates")
def _(spark, sf):
    """Three sweeps, each of every third item."""
    judge = lambda df: prefilter.verdict(scoring.score(df, as_of(), TRACKED), PRIMARY, ALWAYS)
    items = view(spark, sf, "items").select(*FIELDS, "arrival_idx")
    s = Sweeper(spark, _place(spark, "sweep"), judge)
    for epoch in range(3):
        s.sweep(items.where(F.col("arrival_idx") % 3 == epoch), epoch, F.lit(datetime.datetime(2024, 6, 28 + epoch)))
    return s.results().select("epoch", "rank", "url", "title", "score", "carried")


# --- search, verification by look-up, published tables ---
_WORDS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: len(w) > 2 AND w NOT IN ({lst(L.STOP_WORDS)}))"


@query(
    "search_documents",
    f"""WITH w AS (SELECT doc_id AS doc, {_WORDS} AS w FROM documents), x AS (SELECT doc, len(w) AS len, unnest(w) AS term FROM w WHERE len(w) > 0), p AS (SELECT doc, len, term, count(*) AS tf FROM x GROUP BY ALL),
  t AS (SELECT count(*) AS n, avg(len) AS mean FROM (SELECT DISTINCT doc, len FROM p)), i AS (SELECT term, ln(1 + ((SELECT n FROM t) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY term),
  q AS (SELECT DISTINCT item_id AS qid, unnest({_WORDS}) AS term FROM benchmark), s AS (SELECT qid, doc, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT mean FROM t)))) AS score FROM p JOIN q USING (term) JOIN i USING (term) GROUP BY qid, doc)
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS INT) AS rank, doc, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) <= 5""",
)
def _(spark, sf):
    index = search.Index(table(spark, sf, "documents"), "doc_id", "text")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return index.search(queries, 5).withColumn("score", F.round("score", 6))


_SECTIONS = ["dpdpa_board", "sectoral_regulators", "cert_in_breach", "courts_case_law", "international_benchmarks"]


@query(
    "api_stats",
    f"""WITH c AS (SELECT *, {TIER} AS tier FROM cases), g AS (SELECT 'authority' AS kind, coalesce(nullif(trim(authority), ''), 'Unknown') AS name, penalty_amount_inr AS inr FROM c UNION ALL SELECT 'sector', coalesce(nullif(trim(sector), ''), 'Unknown'), penalty_amount_inr FROM c),
  h AS (SELECT kind, name, count(*) AS n, round(sum(inr), 2) AS total FROM g GROUP BY kind, name QUALIFY row_number() OVER (PARTITION BY kind ORDER BY round(sum(inr), 2) DESC, count(*) DESC, name) <= 8)
  SELECT count(*) AS total_cases, count(*) FILTER (tier = 'primary') AS primary_confirmed, round(sum(penalty_amount_inr), 2) AS total_penalty_inr,
  concat_ws(',', {", ".join(f"concat('{x}=', count(*) FILTER (section = '{x}'))" for x in _SECTIONS)}) AS by_section,
  (SELECT string_agg(concat(name, '=', n), ',' ORDER BY total DESC, n DESC, name) FROM h WHERE kind = 'authority') AS by_authority, (SELECT string_agg(concat(name, '=', n), ',' ORDER BY total DESC, n DESC, name) FROM h WHERE kind = 'sector') AS by_sector FROM c""",
)
def _(spark, sf):
    out = publish.api_stats(tiered(spark, sf), _SECTIONS)
    said = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return out.select("total_cases", "primary_confirmed", "total_penalty_inr", said("by_section"), said("by_authority"), said("by_sector"))


@query(
    "watch_list",
    f"""WITH e AS (SELECT company AS name, CASE id % 4 WHEN 0 THEN 'regulator' WHEN 1 THEN 'company' WHEN 2 THEN 'court' ELSE 'case' END AS entity_type, id, id % 3 AS n FROM cases),
  f AS (SELECT trim(name) AS name, id, CASE WHEN entity_type = 'company' THEN 0 WHEN entity_type IN ('regulator', 'court') AND n > 1 THEN 1 END AS level FROM e WHERE length(trim(name)) >= 4),
  g AS (SELECT first(name ORDER BY level, id) AS name, min(level) AS level, first(id ORDER BY level, id) AS id FROM f WHERE level IS NOT NULL GROUP BY lower(name) ORDER BY 2, 3 LIMIT 2000)
  SELECT concat('Watch: ', name) AS name, concat('"', name, '" {L.WATCH_ANCHOR}') AS url, CAST(row_number() OVER (ORDER BY level, id) AS INT) AS at FROM g""",
)
def _(spark, sf):
    c = view(spark, sf, "cases")
    e = c.select(F.col("company").alias("name"), F.expr("CASE id % 4 WHEN 0 THEN 'regulator' WHEN 1 THEN 'company' WHEN 2 THEN 'court' ELSE 'case' END").alias("entity_type"), F.lit("").alias("slug"), F.col("id").alias("first_seen"), (F.col("id") % 3).alias("n_events"))
    return events.watch_list(e, 2000).select("name", "url", "at")


@query(
    "sweep_stats",
    f"""WITH j AS (SELECT arrival_idx, url, keep, reason, carried, score, priority FROM {JUDGED}), k AS (SELECT url FROM j WHERE keep ORDER BY score DESC, carried, priority DESC, arrival_idx LIMIT 15), h AS (SELECT source, CASE WHEN count(*) % 3 = 0 THEN 'blocked' WHEN count(*) % 3 = 1 THEN 'fallback' ELSE 'ok' END AS status FROM items GROUP BY source)
  SELECT (SELECT count(*) FROM h) AS sources_polled, (SELECT count(*) FROM h WHERE status <> 'blocked') AS sources_healthy, (SELECT count(*) FROM h WHERE status = 'blocked') AS sources_dark,
  (SELECT count(*) FROM items) AS raw_items, (SELECT count(*) FROM items WHERE arrival_idx % 9 = 0) AS already_seen, (SELECT count(*) FROM items WHERE arrival_idx % 9 = 1) AS near_duplicates, count(*) FILTER (NOT keep) AS prefilter_rejected, count(*) FILTER (keep) AS kept,
  count(*) FILTER (keep AND carried) AS carried_from_backlog, (SELECT count(*) FROM k) AS candidates, (SELECT count(DISTINCT url) FROM k WHERE url <> '') AS new_urls, count(*) FILTER (keep) - (SELECT count(*) FROM k) AS deferred_to_backlog, 0 AS paid_api_calls,
  (SELECT string_agg(concat(reason, '=', n), ',' ORDER BY reason) FROM (SELECT reason, count(*) AS n FROM j WHERE NOT keep GROUP BY reason)) AS rejection_reasons FROM j""",
)
def _(spark, sf):
    items = view(spark, sf, "items")
    state = F.when(F.col("arrival_idx") % 9 == 0, "seen").when(F.col("arrival_idx") % 9 == 1, "duplicate").otherwise("fresh")
    status = F.element_at(F.array(*map(F.lit, ["blocked", "fallback", "ok"])), (F.col("n") % 3 + 1).cast("int"))
    health = items.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", status.alias("status"))
    found = scratch.stored(judged(spark, sf).select("arrival_idx", "url", "keep", "reason", "carried", "score", "priority"))
    out = publish.sweep_stats(items.select(state.alias("state")), health, found, prefilter.candidates(found.where("keep")))
    reasons = F.array_join(F.transform(F.map_entries("rejection_reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("rejection_reasons", reasons)


# --- the statute, seeds, choices, robots ---
_LISTED = ", ".join(f"({k}, '{n}', '{t}', '{c}')" for k, (n, (t, c)) in enumerate(L.STATUTE_SECTIONS.items()))


@query(
    "statute_pages",
    f"""WITH s AS (SELECT * FROM (VALUES {_LISTED}) AS v(place, number, title, chapter)), k AS (SELECT DISTINCT id, date, unnest(regexp_extract_all(dpdpa_section, '{L.SECTION_REFERENCE}', 1)) AS number FROM cases WHERE contains(lower(dpdpa_section), 'dpdp') OR NOT ({" OR ".join(f"contains(lower(dpdpa_section), '{w}')" for w in L.OTHER_STATUTES)})),
  n AS (SELECT number, count(*) AS n_cases, first(id ORDER BY date DESC, id) AS latest FROM k GROUP BY number),
  r AS (SELECT a.number, b.number AS other, row_number() OVER (PARTITION BY a.number ORDER BY b.place) AS rank FROM s a JOIN s b ON a.chapter = b.chapter AND a.number <> b.number QUALIFY rank <= 4)
  SELECT concat('Section ', number) AS label, title, chapter, concat('dpdpa/section-', number) AS path, coalesce(n_cases, 0) AS n_cases, coalesce(latest, -1) AS latest, coalesce((SELECT string_agg(other, ',' ORDER BY rank) FROM r WHERE r.number = s.number), '') AS related FROM s LEFT JOIN n USING (number)""",
)
def _(spark, sf):
    return reports.statute_pages(view(spark, sf, "cases")).withColumn("latest", F.coalesce("latest", F.lit(-1)))


@query("category_filter", "SELECT id, section, outcome FROM cases WHERE section = 'courts_case_law' AND outcome = 'Consultation'")
def _(spark, sf):
    return reports.chosen(view(spark, sf, "cases"), {"section": "courts_case_law", "outcome": "Consultation", "sector": "", "authority": None}).select("id", "section", "outcome")


@query("seed_rows", "SELECT id, company, false AS auto_detected, false AS needs_review, 'high' AS confidence, CASE WHEN id % 4 = 0 THEN 'from the register' ELSE 'Curated baseline — verify against source.' END AS notes, '2024-06-30' AS updated_at FROM cases")
def _(spark, sf):
    c = view(spark, sf, "cases").withColumn("notes", F.when(F.col("id") % 4 == 0, "from the register"))
    return reports.seeded(c, as_of()).select("id", "company", "auto_detected", "needs_review", "confidence", "notes", F.col("updated_at").cast("string").alias("updated_at"))


@query("unrecorded_items", "SELECT arrival_idx, url FROM items WHERE url NOT IN (SELECT url FROM items WHERE arrival_idx % 4 = 0)")
def _(spark, sf):
    i = view(spark, sf, "items").select("url", "arrival_idx")
    return reports.unrecorded(i, i.where("arrival_idx % 4 = 0")).select("arrival_idx", "url")


@query("entity_partitions", "SELECT kind, count(*) AS n FROM (SELECT CASE id % 4 WHEN 0 THEN 'regulators' WHEN 1 THEN 'companies' WHEN 2 THEN 'regulators' END AS kind FROM cases) WHERE kind IS NOT NULL GROUP BY kind")
def _(spark, sf):
    e = view(spark, sf, "cases").select("id", F.expr("CASE id % 4 WHEN 0 THEN 'regulator' WHEN 1 THEN 'company' WHEN 2 THEN 'court' ELSE 'case' END").alias("entity_type"))
    both = graph.companies(e).select(F.lit("companies").alias("kind")).unionByName(graph.regulators(e).select(F.lit("regulators").alias("kind")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_ROBOTS = "concat('User-agent: *\\nDisallow: /admin', CAST(page_id AS STRING), '\\nuser-agent: Bot', CAST(page_id % 5 AS STRING), '\\nDisallow: /x\\n', CASE WHEN page_id % 3 = 0 THEN 'Sitemap: https://h/s.xml' ELSE '' END)"


@query("robots_files", "SELECT url, concat('*,Bot', page_id % 5) AS agents, concat('/admin', page_id, ',/x') AS disallowed, page_id % 3 = 0 AS sitemap FROM pages")
def _(spark, sf):
    files = table(spark, sf, "pages").select("url", F.expr(_ROBOTS).alias("body"))
    r = insights.robots(files)
    return r.select("url", F.array_join("agents", ",").alias("agents"), F.array_join("disallowed", ",").alias("disallowed"), "sitemap")
