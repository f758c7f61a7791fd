"""Further registered queries: the event model, verification, the registry, orders and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import events, graph, insights, prefilter, publish, reports, state, verification
from ..sources.tables import table, view
from .catalogue import _AMOUNTS, _EDGES, JUDGED, SLUG, TIER, anyof, as_of, entity_sql, judged, lst, query, routed, rx

LABELS = {"dpdpa_board": "Board", "cert_in_breach": "Breach", "courts_case_law": "Courts"}


def listed(spark, sf):
    c = view(spark, sf, "cases")
    # every tenth case has a slug from an earlier run
    c = c.withColumn("slug", F.when(F.col("id") % 10 == 0, F.concat(F.lit("kept-"), F.col("id").cast("string"))))
    return c.withColumn("listed", F.array(F.struct(F.lit("paper").alias("source"), F.col("source_url").alias("url")), F.struct(F.lit("again").alias("source"), F.col("official_source_url").alias("url"))))


@query("public_rows", "SELECT id, date, authority, company, sector, violation_type, dpdpa_section, summary, penalty_amount, outcome, source_url, official_source_url, '' AS trust_tier, '' AS slug, penalty_amount_inr FROM cases")
def _(spark, sf):
    c = view(spark, sf, "cases")
    return events.public_rows(c.withColumn("sector", F.nullif("sector", F.lit("Other"))).withColumn("penalty_amount_inr", F.nullif("penalty_amount_inr", F.lit(0.0))))


_TITLE = "concat_ws(' — ', nullif(company, ''), CASE WHEN authority <> '' AND lower(authority) <> 'unknown' THEN authority END, nullif(left(date, 4), ''))"
_URLS = "CASE WHEN official_source_url <> '' THEN [official_source_url, source_url] ELSE [source_url] END"
# of a base the first case in order of arrival has it as it is, the others their number; stored slugs stay
_NUMBER = f"row_number() OVER (PARTITION BY id % 10 = 0, {SLUG} ORDER BY arrival_idx)"
_PATH = f"concat('enforcement/', CASE WHEN id % 10 = 0 THEN concat('kept-', id) WHEN {_NUMBER} = 1 THEN {SLUG} ELSE concat({SLUG}, '-', {_NUMBER}) END)"
_LABEL = "CASE section " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE 'Enforcement' END"


@query("event_model", f"SELECT id, date, {TIER} AS trust_tier, CAST(len({_URLS}) AS INT) AS n_sources, ({_URLS})[1] AS primary_url, {_TITLE} AS title, left(date, 4) AS year, {_LABEL} AS section_label, {_PATH} AS url_path FROM cases")
def _(spark, sf):
    return events.events(listed(spark, sf), LABELS).select("id", "date", "trust_tier", F.size("sources").alias("n_sources"), "primary_url", "title", "year", "section_label", "url_path")


@query("event_order", f"SELECT id, date, {_TITLE} AS title FROM cases ORDER BY date DESC, arrival_idx LIMIT 2000")
def _(spark, sf):
    c = view(spark, sf, "cases").orderBy(F.desc("date"), "arrival_idx").limit(2000)
    return c.select("id", "date", events.title("company", "authority", "date").alias("title"))


@query(
    "csv_events",
    f"SELECT id, date, section, authority, company, sector, violation_type, dpdpa_section, penalty_amount, penalty_amount_inr, outcome, {TIER} AS trust_tier, source_url, array_to_string({_URLS}, ' | ') AS sources, {_PATH} AS url_path FROM cases",
)
def _(spark, sf):
    return events.csv_rows(events.events(listed(spark, sf), LABELS))


@query("llms_lines", f"SELECT concat('- [', {_TITLE}, '](https://base.example/', {_PATH}, ')') AS value FROM cases")
def _(spark, sf):
    return reports.llms_lines(events.events(listed(spark, sf), LABELS), "https://base.example")


_RX_MONEY = L.EXTRACTED_MONEY.replace("'", "''")
_HEUR = "(SELECT *, concat_ws(' ', title, summary) AS b, lower(concat_ws(' ', title, summary)) AS t FROM items)"
_XSUM = "concat('AUTO-DETECTED: ', title, '. Snippet: ', left(summary, 280))"


@query(
    "extraction_record",
    f"SELECT arrival_idx, true AS is_genuine_enforcement, 'Unknown' AS x_authority, '[Needs review — see source]' AS x_company, {routed('t', L.SECTOR_RULES, L.SECTOR_DEFAULT)} AS x_sector, '[Auto-flagged — verify]' AS x_violation, trim(regexp_extract(b, '{_RX_MONEY}', 0)) AS x_penalty, 'Investigation Ongoing' AS x_outcome, {_XSUM} AS x_summary, 'low' AS x_confidence FROM {_HEUR} WHERE {rx('t', L.ENFORCEMENT_SIGNAL)}",
)
def _(spark, sf):
    r = events.heuristic_record(view(spark, sf, "items"))
    return r.select("arrival_idx", "is_genuine_enforcement", *[f"x_{c}" for c in ("authority", "company", "sector", "violation", "penalty", "outcome", "summary", "confidence")])


_NAMED = "CASE arrival_idx % 4 WHEN 0 THEN 'CERT-In' WHEN 1 THEN 'MeitY' WHEN 2 THEN 'Unknown' ELSE '' END"
_COMBINED = f"concat_ws(' ', title, {_XSUM}, '[Auto-flagged — verify]')"


@query(
    "candidate_rows",
    f"""SELECT arrival_idx, CASE a WHEN 'CERT-In' THEN 'cert_in_breach' WHEN 'MeitY' THEN 'dpdpa_board' ELSE {routed('lower(concat_ws(chr(32), a, c))', L.SECTION_RULES, L.SECTION_DEFAULT)} END AS section, coalesce(nullif(a, ''), 'Unknown') AS authority,
  '[Needs review — see source]' AS company, CASE WHEN x <> 'Other' THEN x ELSE {routed('lower(c)', L.SECTOR_RULES, L.SECTOR_DEFAULT)} END AS sector, true AS needs_review, CASE WHEN arrival_idx % 5 = 0 THEN 'high' ELSE 'low' END AS confidence, url AS source_url,
  concat('AUTO-2024-', upper(left(md5(url), 8))) AS id, published AS date, '[Auto-flagged — verify]' AS violation_type, {_XSUM} AS summary, trim(regexp_extract(b, '{_RX_MONEY}', 0)) AS penalty_amount, 0.0 AS penalty_amount_inr, 'Investigation Ongoing' AS outcome,
  CASE WHEN arrival_idx % 5 = 0 THEN 'https://rbi.org.in/x' ELSE '' END AS official_source_url, true AS auto_detected
  FROM (SELECT *, {_NAMED} AS a, {_COMBINED} AS c, {routed('t', L.SECTOR_RULES, L.SECTOR_DEFAULT)} AS x FROM {_HEUR} WHERE {rx('t', L.ENFORCEMENT_SIGNAL)})""",
)
def _(spark, sf):
    r = events.heuristic_record(view(spark, sf, "items")).withColumn("x_authority", F.expr(_NAMED)).withColumn("official_url", F.expr("CASE WHEN arrival_idx % 5 = 0 THEN 'https://rbi.org.in/x' ELSE '' END"))
    return events.candidate_rows(r, as_of()).drop("dpdpa_section", "extracted")


@query("trusted_sources", f"SELECT id, {anyof('u', L.TRUSTED_DOMAINS)} AS trusted, {anyof('u', L.AGGREGATOR_HOSTS)} AS aggregator FROM (SELECT id, CASE id % 3 WHEN 0 THEN concat('https://www.rbi.org.in/', id) WHEN 1 THEN 'https://news.google.com/rss/a' ELSE source_url END AS u FROM cases)")
def _(spark, sf):
    c = view(spark, sf, "cases").withColumn("u", F.expr("CASE id % 3 WHEN 0 THEN concat('https://www.rbi.org.in/', id) WHEN 1 THEN 'https://news.google.com/rss/a' ELSE source_url END"))
    return c.select("id", events.is_trusted("u").alias("trusted"), events.is_aggregator("u").alias("aggregator"))


_SITES = "CASE a " + " ".join(f"WHEN '{k}' THEN '{' OR '.join('site:' + d for d in v)}'" for k, v in L.AUTHORITY_DOMAINS.items()) + f" ELSE '{' OR '.join('site:' + d for d in L.TRUSTED_DOMAINS[:6])}' END"


@query("official_queries", f"SELECT id, trim(concat('(', {_SITES}, ') ', company, ' ', violation_type)) AS query, concat('https://feed.example/?q=', replace(replace(company, ' ', '+'), '#', '%23')) AS feed FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'SEBI' WHEN 1 THEN 'MeitY' ELSE authority END AS a FROM cases)")
def _(spark, sf):
    c = view(spark, sf, "cases").withColumn("a", F.expr("CASE id % 3 WHEN 0 THEN 'SEBI' WHEN 1 THEN 'MeitY' ELSE authority END"))
    return c.select("id", events.official_query("company", "a", "violation_type").alias("query"), events.feed_url("https://feed.example/?q=", F.col("company")).alias("feed"))


# --- verification ---
_VDOC = "concat('The authority issued an order on ', date, ' in the matter of ', CASE WHEN id % 3 = 0 THEN 'another firm' ELSE company END, ' and directed payment of ', CASE WHEN id % 2 = 1 THEN penalty_amount ELSE 'nothing' END, '. The order is final and binding on all parties.')"
_VCASES = "(SELECT *, CASE WHEN official_source_url <> '' THEN concat('https://rbi.org.in/o/', id) ELSE '' END AS official FROM cases)"
_TOKS = f"list_filter(string_split({entity_sql('company')}, ' '), lambda w: len(w) > 2 AND w NOT IN ({lst(L.WEAK_TOKENS)}))"
_PARSED = _AMOUNTS.replace("FROM cases", "FROM docs")
_VSQL = f"""WITH docs AS (SELECT id, {_VDOC} AS penalty_amount FROM {_VCASES} WHERE official <> '' AND id % 8 <> 5), {_PARSED}, found AS (SELECT * FROM amounts WHERE value > 0),
own AS ({_AMOUNTS.replace('amounts AS (', '', 1)[:-1]}), claim AS (SELECT id, arg_max(value, value) AS value, arg_max(currency, value) AS currency FROM own WHERE value > 0 GROUP BY id),
am AS (SELECT DISTINCT f.id FROM found f JOIN claim c ON f.id = c.id AND f.currency = c.currency AND abs(f.value - c.value) / greatest(f.value, c.value) <= 0.02),
v AS (SELECT c.id, c.arrival_idx, official, d.penalty_amount AS doc, len({_TOKS}) AS k, len(list_filter({_TOKS}, lambda w: contains(concat(' ', regexp_replace(lower(coalesce(d.penalty_amount, '')), '[^a-z0-9_]', ' ', 'g')), concat(' ', w)))) AS hit,
  c.id IN (SELECT id FROM am) AS a, contains(lower(coalesce(d.penalty_amount, '')), date) AS dt FROM {_VCASES} c LEFT JOIN docs d ON c.id = d.id),
e AS (SELECT *, CASE WHEN k = 0 THEN false WHEN k = 1 THEN hit >= 1 ELSE hit >= greatest(2, (k + 1) // 2) END AS e FROM v),
r AS (SELECT *, official <> '' AND doc IS NOT NULL AND e AND (a OR dt) AS verified FROM e)"""


def verified_cases(spark, sf):
    c = view(spark, sf, "cases").withColumn("official_source_url", F.expr("CASE WHEN official_source_url <> '' THEN concat('https://rbi.org.in/o/', id) ELSE '' END")).withColumn("penalty", F.col("penalty_amount"))
    docs = c.where("official_source_url <> '' AND id % 8 <> 5").select(F.col("official_source_url").alias("url"), F.expr(_VDOC).alias("document"))
    return verification.verify(c, docs, L.TRUSTED_DOMAINS)


@query(
    "verify_cases",
    f"{_VSQL} SELECT id, official AS official_url, verified, CASE WHEN verified THEN 'primary' ELSE 'press' END AS trust_tier, CASE WHEN official = '' THEN 'no_official_source_found' WHEN doc IS NULL THEN 'official_source_unreachable' ELSE '' END AS note, CASE WHEN official = '' OR doc IS NULL THEN 'weak' WHEN e AND a THEN 'strong' WHEN e AND dt THEN 'moderate' ELSE 'weak' END AS strength, CAST(CASE WHEN official <> '' THEN 2 ELSE 1 END AS INT) AS independent_sources FROM r",
)
def _(spark, sf):
    return verified_cases(spark, sf).select("id", "official_url", "verified", "trust_tier", "note", "strength", "independent_sources")


@query("evidence_rows", f"{_VSQL} SELECT id AS action_id, official AS official_url, sha256(doc) AS content_hash, CASE WHEN a THEN 'strong' ELSE 'moderate' END AS strength, row_number() OVER (ORDER BY arrival_idx) <= 10 AS archive FROM r WHERE verified")
def _(spark, sf):
    return verification.evidence_rows(verified_cases(spark, sf)).drop("excerpt")


@query("publish_gate", f"{_VSQL} SELECT id, verified AND e AND a AS publish FROM r")
def _(spark, sf):
    return verified_cases(spark, sf).select("id", verification.publishable(True).alias("publish"))


# a case has up to three results; the words may stand in any of them, and past 2,500 signs they count no more
_FOUND = """(SELECT id, k AS rank, CASE WHEN (id + k) % 5 = 0 THEN 'The regulator imposed a penalty on the firm' WHEN (id + k) % 7 = 0 THEN concat(repeat('no news ', 330), 'and the matter was settled') ELSE 'Nothing new' END AS title,
  concat('Report ', k) AS summary, CASE WHEN k = id % 3 THEN concat('https://www.rbi.org.in/', id) ELSE concat('https://blog.example/', k) END AS url FROM cases, (SELECT unnest([0, 1, 2]) AS k) WHERE id % 4 > k)"""


@query(
    "reverify_patch",
    f"""SELECT id, CASE WHEN h THEN 'Fine Imposed' ELSE outcome END AS outcome, CASE WHEN h THEN 'Auto-flagged possible resolution — verify.' ELSE '' END AS notes, CASE WHEN h THEN coalesce(official, '') ELSE official_source_url END AS official_source_url, true AS stamped
  FROM (SELECT c.id, outcome, official_source_url, official, coalesce({anyof('low', L.RESOLVED_WORDS)}, false) AS h FROM cases c LEFT JOIN
  (SELECT id, lower(left(string_agg(concat(title, ' ', summary), ' ' ORDER BY rank), 2500)) AS low, min_by(url, rank) FILTER ({anyof('url', L.TRUSTED_DOMAINS)}) AS official FROM {_FOUND} GROUP BY id) r ON c.id = r.id WHERE outcome IN ('Investigation Ongoing', 'Consultation'))""",
)
def _(spark, sf):
    c = view(spark, sf, "cases").where(F.col("outcome").isin(L.OPEN_OUTCOMES)).select("id", "outcome", "official_source_url")
    hit = F.when((F.col("id") + F.col("rank")) % 5 == 0, "The regulator imposed a penalty on the firm").when((F.col("id") + F.col("rank")) % 7 == 0, F.concat(F.repeat(F.lit("no news "), 330), F.lit("and the matter was settled"))).otherwise("Nothing new")
    found = c.select("id", F.explode(F.array(*map(F.lit, range(3)))).alias("rank")).where("id % 4 > rank").withColumns({"title": hit, "summary": F.concat(F.lit("Report "), F.col("rank").cast("string"))})
    found = found.withColumn("url", F.when(F.col("rank") == F.col("id") % 3, F.concat(F.lit("https://www.rbi.org.in/"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("https://blog.example/"), F.col("rank").cast("string"))))
    return verification.resolution_patch(c, found, L.RESOLVED_WORDS)


# --- the graph ---
_TYPES = f"(SELECT entity, CASE WHEN bool_or(role = 'authority') THEN 'regulator' ELSE 'company' END AS entity_type, count(DISTINCT event_id) AS n_events FROM {_EDGES} GROUP BY entity)"


def typed(spark, sf):
    e = graph.edges(view(spark, sf, "cases"))
    kind = F.when(F.bool_or(F.col("role") == "authority"), "regulator").otherwise("company")
    return e, e.groupBy("entity").agg(kind.alias("entity_type"), F.count_distinct("event_id").alias("n_events"))


@query("entity_events", f"SELECT entity, count(*) AS n, min(event_id) AS first FROM (SELECT DISTINCT entity, event_id FROM {_EDGES}) GROUP BY entity")
def _(spark, sf):
    return reports.entity_events(graph.edges(view(spark, sf, "cases"))).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("entity_counts", f"SELECT c_name AS name, coalesce(n, 0) AS n FROM (SELECT DISTINCT c_name, {entity_sql('c_name')} AS entity FROM customer) LEFT JOIN (SELECT entity, count(DISTINCT event_id) AS n FROM {_EDGES} GROUP BY entity) USING (entity)")
def _(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_name").alias("name"), T.entity_key("c_name").alias("entity")).distinct()
    return reports.entity_counts(names, graph.edges(view(spark, sf, "cases"))).select("name", "n")


@query("pageable_entities", f"SELECT entity, entity_type, n_events FROM {_TYPES} WHERE n_events > 0")
def _(spark, sf):
    return graph.pageable(typed(spark, sf)[1])


@query("graph_counters", f"SELECT (SELECT count(*) FROM cases) AS events, count(*) AS entities, count(*) FILTER (WHERE entity_type = 'company') AS companies, count(*) FILTER (WHERE entity_type = 'regulator') AS regulators, (SELECT count(*) FROM (SELECT event_id FROM claims GROUP BY event_id, field HAVING count(DISTINCT coalesce(nullif(replace(regexp_extract(value, '\\d[\\d,]*(?:\\.\\d+)?', 0), ',', ''), ''), lower(trim(value)))) > 1)) AS contradictions FROM {_TYPES}")
def _(spark, sf):
    return reports.graph_counters(view(spark, sf, "cases"), typed(spark, sf)[1], graph.contradictions(view(spark, sf, "claims")))


@query("watch_entities", f"SELECT entity AS name, entity_type, n_events FROM {_TYPES} WHERE length(entity) >= 4 AND entity NOT IN ('asia', 'africa') AND (entity_type = 'company' OR n_events > 1) ORDER BY entity_type <> 'company', n_events DESC, entity LIMIT 40")
def _(spark, sf):
    return reports.watch_entities(typed(spark, sf)[1].withColumnRenamed("entity", "name"), ["asia", "africa"])


@query("entities_sorted", f"SELECT entity, n_events FROM {_TYPES} ORDER BY lower(entity) LIMIT 100")
def _(spark, sf):
    return typed(spark, sf)[1].orderBy(F.lower("entity")).limit(100).select("entity", "n_events")


@query("section_related", "SELECT n_nationkey, related, CAST(rank AS INT) AS rank FROM (SELECT a.n_nationkey, b.n_nationkey AS related, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_nationkey) AS rank FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey) WHERE rank <= 4")
def _(spark, sf):
    return reports.related_in_group(table(spark, sf, "nation"), "n_regionkey", "n_nationkey", "n_nationkey")


# --- the registry and orders ---
_REGISTRY = "(SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'docwatch' ELSE 'search' END AS kind, CAST(s_suppkey % 4 AS INT) AS tier, s_suppkey % 2 = 0 AS is_primary, s_acctbal > 0 AS enabled FROM supplier)"


def registry(spark, sf):
    t = table(spark, sf, "supplier")
    return t.selectExpr("s_name AS name", "CASE s_suppkey % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'docwatch' ELSE 'search' END AS kind", "CAST(s_suppkey % 4 AS INT) AS tier", "s_suppkey % 2 = 0 AS is_primary", "s_acctbal > 0 AS enabled")


@query("registry_stats", f"SELECT kind, CAST(tier AS VARCHAR) AS tier, count(*) AS n, count(*) FILTER (WHERE is_primary) AS n_primary, CAST(grouping(kind, tier) AS INT) AS level FROM {_REGISTRY} r GROUP BY GROUPING SETS ((kind), (tier), ())")
def _(spark, sf):
    return reports.registry_stats(registry(spark, sf)).withColumn("tier", F.col("tier").cast("string"))


@query("registry_enabled", f"SELECT name, kind, tier FROM {_REGISTRY} WHERE enabled AND tier <= 2")
def _(spark, sf):
    return reports.enabled(registry(spark, sf), up_to=2).select("name", "kind", "tier")


@query("oldest_evidence", "SELECT action_id, url, strength FROM evidence QUALIFY row_number() OVER (PARTITION BY action_id ORDER BY arrival, url) = 1")
def _(spark, sf):
    return reports.oldest_evidence(view(spark, sf, "evidence"))


_HEALTH = "(SELECT source, count(*) AS items, CASE WHEN count(*) FILTER (WHERE action = 'alerted') > 0 THEN 'ok' ELSE 'empty' END AS status FROM stories WHERE score > 17 GROUP BY source)"


def health(spark, sf):
    s = view(spark, sf, "stories").where("score > 17").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("action") == "alerted").alias("ok"))
    return s.withColumn("status", F.when(F.col("ok") > 0, "ok").otherwise("empty"))


@query("health_totals", f"SELECT count(*) FILTER (WHERE status = 'ok') AS healthy, count(*) FILTER (WHERE status <> 'ok') AS dark, CAST(sum(items) AS BIGINT) AS items FROM {_HEALTH}")
def _(spark, sf):
    return reports.health_totals(health(spark, sf))


@query("health_order", f"SELECT source, items, status FROM {_HEALTH} ORDER BY status <> 'ok', items DESC, source LIMIT 5")
def _(spark, sf):
    return health(spark, sf).orderBy(F.col("status") != "ok", F.desc("items"), "source").limit(5).select("source", "items", "status")


@query("gap_summary", "SELECT count(*) AS crawled, count(g) AS gaps, string_agg(DISTINCT g, ',' ORDER BY g) AS keywords FROM (SELECT CASE WHEN contains(lower(title), 'consent') THEN 'consent' WHEN contains(lower(title), 'breach') THEN 'breach' END AS g FROM items)")
def _(spark, sf):
    return reports.gap_summary(view(spark, sf, "items"), "title", ["consent", "breach"])


@query("deferred_items", f"SELECT arrival_idx FROM {JUDGED} WHERE keep QUALIFY row_number() OVER (ORDER BY score DESC, carried, priority DESC, arrival_idx) > 15")
def _(spark, sf):
    kept = judged(spark, sf).where("keep")
    return prefilter.deferred(kept, prefilter.candidates(kept)).select("arrival_idx")


@query("trace_order", f"SELECT arrival_idx, score FROM (SELECT *, CASE WHEN NOT keep THEN 2 WHEN score >= 12 THEN 0 ELSE 1 END AS o FROM {JUDGED}) ORDER BY o, score DESC, arrival_idx LIMIT 1200")
def _(spark, sf):
    j = judged(spark, sf).withColumn("verdict", F.when(~F.col("keep"), F.col("reason")).when(F.col("score") >= 12, "candidate").otherwise("deferred"))
    return reports.trace_order(j).select("arrival_idx", "score")


@query("trace_verdicts", f"SELECT i.arrival_idx, j.reason FROM items i LEFT JOIN (SELECT url, arg_min(reason, arrival_idx) AS reason FROM {JUDGED} GROUP BY url) j USING (url)")
def _(spark, sf):
    first = prefilter.first_per(judged(spark, sf).select("url", "arrival_idx", "reason"), "url", ["arrival_idx"]).select("url", "reason")
    return view(spark, sf, "items").select("url", "arrival_idx").join(first, "url", "left").select("arrival_idx", "reason")


@query("reason_filter", f"SELECT arrival_idx FROM {JUDGED} WHERE reason = 'noise_pattern'")
def _(spark, sf):
    return judged(spark, sf).where(F.col("reason") == "noise_pattern").select("arrival_idx")


@query("seen_cache", "SELECT url, max(arrival_idx) AS last_seen FROM items GROUP BY url ORDER BY max(arrival_idx) DESC, url LIMIT 500")
def _(spark, sf):
    return reports.seen_cache(view(spark, sf, "items").select("url", F.col("arrival_idx").alias("last_seen")), 500)


@query("unseen_items", "SELECT arrival_idx FROM items WHERE url <> '' AND url NOT IN (SELECT url FROM items WHERE arrival_idx % 3 = 0)")
def _(spark, sf):
    from ..sources import feeds

    i = view(spark, sf, "items")
    return feeds.unseen(i, i.where("arrival_idx % 3 = 0")).select("arrival_idx")


@query("known_urls", "SELECT url FROM items WHERE arrival_idx % 3 = 0 INTERSECT SELECT url FROM items WHERE arrival_idx % 7 = 0")
def _(spark, sf):
    i = view(spark, sf, "items").select("url", "arrival_idx")
    return i.where("arrival_idx % 3 = 0").select("url").intersect(i.where("arrival_idx % 7 = 0").select("url"))


@query("recorded_sources", "SELECT arrival_idx, url IN (SELECT url FROM items WHERE arrival_idx % 4 = 0) AS recorded FROM items")
def _(spark, sf):
    i = view(spark, sf, "items").select("url", "arrival_idx")
    known = i.where("arrival_idx % 4 = 0").select("url").distinct().withColumn("recorded", F.lit(True))
    return i.join(known, "url", "left").select("arrival_idx", F.coalesce("recorded", F.lit(False)).alias("recorded"))


@query("latest_brief", "SELECT story_id, headline FROM stories ORDER BY processed_at DESC, story_id LIMIT 1")
def _(spark, sf):
    return view(spark, sf, "stories").orderBy(F.desc("processed_at"), "story_id").limit(1).select("story_id", "headline")


@query("recent_decisions", "SELECT id, action, decided_at FROM decisions ORDER BY decided_at DESC, id LIMIT 200")
def _(spark, sf):
    return view(spark, sf, "decisions").orderBy(F.desc("decided_at"), "id").limit(200).select("id", "action", "decided_at")


@query("score_badges", "SELECT CASE WHEN score >= 12 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END AS badge, CASE WHEN m < 60 THEN concat(m, 'm ago') WHEN m < 1440 THEN concat(m // 60, 'h ago') ELSE concat(m // 1440, 'd ago') END AS ago, count(*) AS n FROM (SELECT score, story_id * 7 % 5000 AS m FROM stories) GROUP BY ALL")
def _(spark, sf):
    s = view(spark, sf, "stories")
    return s.groupBy(reports.score_badge(F.col("score")).alias("badge"), reports.time_ago((F.col("story_id") * 7 % 5000) * 60).alias("ago")).agg(F.count(F.lit(1)).alias("n"))


@query("decision_texts", f"SELECT arrival_idx, left(concat(title, '. '), 200) AS title, left(summary, 280) AS snippet FROM {_HEUR} WHERE {rx('t', L.ENFORCEMENT_SIGNAL)}")
def _(spark, sf):
    r = events.heuristic_record(view(spark, sf, "items"))
    return reports.decision_texts(r.select("arrival_idx", F.col("x_summary").alias("summary")))


@query("guarded_text", "SELECT doc_id, CASE WHEN length(text) >= 200 THEN text ELSE coalesce(nullif(source, ''), text) END AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", reports.guarded_text(F.col("text"), F.col("source")).alias("text"))


@query("angles", "SELECT story_id, concat('What it means: ', headline) AS angle FROM stories WHERE score >= 8 ORDER BY score DESC, story_id LIMIT 8")
def _(spark, sf):
    return reports.angles(view(spark, sf, "stories"))


@query("run_log", "SELECT source AS job, action AS status, left(string_agg(headline, ', ' ORDER BY story_id), 500) AS detail, count(*) AS items_found FROM stories GROUP BY source, action")
def _(spark, sf):
    s = view(spark, sf, "stories").groupBy(F.col("source").alias("job"), F.col("action").alias("status"))
    s = s.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("story_id", "headline"))), lambda x: x["headline"]), ", ").alias("detail"), F.count(F.lit(1)).alias("items_found"))
    return reports.run_log(s)


@query("alert_payloads", "SELECT story_id, concat('{\"text\":\"[', score, '] ', headline, ' (', source, ')\"}') AS payload FROM stories WHERE score >= 12")
def _(spark, sf):
    return insights.alert_payload(view(spark, sf, "stories"))


_LISTED = f"(SELECT lower(trim(unnest([company, concat(authority, '/', sector)]))) AS v FROM (SELECT * FROM cases WHERE trim(company) <> ''))"
_KEPT = f"list_filter(regexp_split_to_array(trim(regexp_replace(v, '[/\\s-]+', ' ', 'g')), ' '), lambda w: len(w) >= 4 AND w NOT IN ({lst(L.GENERIC_NAME_WORDS)}))"


@query("tracked_terms", f"SELECT DISTINCT term FROM (SELECT v AS term FROM {_LISTED} UNION ALL SELECT t[1] FROM (SELECT {_KEPT} AS t FROM {_LISTED}) UNION ALL SELECT concat(t[1], ' ', t[2]) FROM (SELECT {_KEPT} AS t FROM {_LISTED}) WHERE len(t) > 1) WHERE len(term) >= 4")
def _(spark, sf):
    c = view(spark, sf, "cases").select(F.col("company").alias("name"), F.array(F.concat("authority", F.lit("/"), "sector")).alias("aliases"), "arrival_idx")
    return insights.tracked_terms(c, "arrival_idx", None)


@query("calendar", f"SELECT date, title, curated, CAST(datediff('day', DATE '1998-01-01', CAST(date AS DATE)) AS INT) AS days_away FROM (SELECT date, company AS title, true AS curated FROM cases WHERE id % 50 = 0 UNION ALL SELECT date, company, false FROM cases WHERE id % 50 <> 0 AND date NOT IN (SELECT date FROM cases WHERE id % 50 = 0))")
def _(spark, sf):
    c = view(spark, sf, "cases").select("id", "date", F.col("company").alias("title"), F.col("summary").alias("description"))
    return insights.calendar(c.where("id % 50 = 0").drop("id"), c.where("id % 50 <> 0").drop("id"), F.to_date(F.lit("1998-01-01"))).select("date", "title", "curated", "days_away")


@query("few_shot", "SELECT string_agg(line, chr(10) ORDER BY decided_at, line) AS block FROM (SELECT decided_at, concat(CASE WHEN action = 'discard' THEN 'NOT A CASE' ELSE 'CASE' END, ': case ', id) AS line FROM decisions ORDER BY decided_at LIMIT 6)")
def _(spark, sf):
    return insights.few_shot(view(spark, sf, "decisions").withColumn("title", F.concat(F.lit("case "), F.col("id").cast("string"))))


@query("brief_totals", "SELECT section AS key, 'section' AS kind, count(*) AS n FROM cases GROUP BY section UNION ALL SELECT sector, 'sector', count(*) FROM cases GROUP BY sector UNION ALL SELECT 'all', 'penalty', CAST(round(sum(penalty_amount_inr)) AS BIGINT) FROM cases")
def _(spark, sf):
    c = view(spark, sf, "cases")
    one = lambda k: c.groupBy(F.col(k).alias("key")).agg(F.count(F.lit(1)).alias("n")).select("key", F.lit(k).alias("kind"), "n")
    total = c.agg(F.round(F.sum("penalty_amount_inr")).cast("long").alias("n")).select(F.lit("all").alias("key"), F.lit("penalty").alias("kind"), "n")
    return one("section").unionByName(one("sector")).unionByName(total)


@query("brief_provisions", "SELECT trim(dpdpa_section) AS value, count(*) AS n FROM cases WHERE trim(dpdpa_section) <> '' GROUP BY 1 ORDER BY count(*) DESC, min(arrival_idx) LIMIT 4")
def _(spark, sf):
    return publish.most_common(view(spark, sf, "cases").withColumn("dpdpa_section", F.trim("dpdpa_section")), "dpdpa_section")


@query("penalty_total", "SELECT round(sum(penalty_amount_inr), 2) AS total FROM cases")
def _(spark, sf):
    return view(spark, sf, "cases").agg(F.round(F.sum("penalty_amount_inr"), 2).alias("total"))


@query("freshness", "SELECT count(*) - count(*) FILTER (WHERE NOT needs_review) AS behind FROM cases")
def _(spark, sf):
    return view(spark, sf, "cases").agg((F.count(F.lit(1)) - F.count_if(~F.col("needs_review"))).alias("behind"))


@query("classifier_misses", "SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE (quality = 1) <> (NOT contains(text, '!!'))")
def _(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return rows.where((F.col("quality") == 1) != ~F.contains("text", F.lit("!!"))).select("doc_id")


@query("json_objects", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("said", F.concat(F.lit("so: "), "props", F.lit(" end")))
    return e.select("event_id", F.from_json(T.json_object("said"), "k bigint")["k"].alias("k"))


@query("case_updates", "SELECT id, CASE WHEN id % 6 = 0 THEN 'discarded' ELSE outcome END AS outcome FROM cases WHERE id % 10 <> 3")
def _(spark, sf):
    c = state.delete(view(spark, sf, "cases"), F.col("id") % 10 == 3)
    return state.update(c, F.col("id") % 6 == 0, {"outcome": F.lit("discarded")}).select("id", "outcome")


@query("story_upsert_repeats", "SELECT story_id, score FROM (SELECT story_id, score FROM stories WHERE story_id >= 100 UNION ALL SELECT story_id % 100, arg_max(score, story_id) FROM stories GROUP BY 1)")
def _(spark, sf):
    s = view(spark, sf, "stories").select("story_id", "score")
    new = s.select((F.col("story_id") % 100).alias("story_id"), "score", F.col("story_id").alias("at"))
    return state.upsert(s, new, ["story_id"], order="at")


@query("scan_limit", "SELECT id, date FROM cases ORDER BY id LIMIT 2000")
def _(spark, sf):
    return view(spark, sf, "cases").orderBy("id").limit(2000).select("id", "date")
