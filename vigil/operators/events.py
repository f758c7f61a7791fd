"""The event model: public rows, sources, titles, candidates and extraction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..functions import lexicons as L
from ..functions import text as T
from . import clustering, verification

DEFAULTS = {"date": "", "authority": "", "company": "", "sector": "Other", "violation_type": "", "dpdpa_section": "", "summary": "", "penalty_amount": "", "outcome": "", "source_url": "", "official_source_url": "", "trust_tier": "", "slug": ""}
NO_SOURCES = "array<struct<url:string,name:string,is_primary:boolean>>"


def public_rows(rows: DataFrame) -> DataFrame:
    """The public columns with their defaults; the penalty as a number, 0 without one. Columns that are missing have the default."""
    value = lambda c, d: (F.coalesce(F.col(c), F.lit(d)) if c in rows.columns else F.lit(d)).alias(c)
    return rows.select("id", *[value(c, d) for c, d in DEFAULTS.items()], F.coalesce(F.col("penalty_amount_inr").cast("double"), F.lit(0.0)).alias("penalty_amount_inr"))


def collect_sources(official: Column, listed: Column, source: Column) -> Column:
    """array<struct<url, name, is_primary>>: the official one, then the listed ones, then the source's URL; the first of each URL."""
    one = lambda u, n, p: F.struct(u.alias("url"), n.alias("name"), F.lit(p).alias("is_primary"))
    all_ = F.concat(
        F.array(one(T.filled(official), F.lit(""), True)),
        F.transform(F.coalesce(listed, F.array().cast("array<struct<source:string,url:string>>")), lambda s: one(T.filled(s["url"]), T.filled(s["source"]), False)),
        F.array(one(T.filled(source), F.lit(""), False)),
    )
    filled = F.filter(all_, lambda s: s["url"] != "")
    # a source stays if no earlier one has its URL; lists of sources are short
    return F.aggregate(filled, F.array().cast(NO_SOURCES), lambda out, s: F.when(F.exists(out, lambda o: o["url"] == s["url"]), out).otherwise(F.concat(out, F.array(s.cast("struct<url:string,name:string,is_primary:boolean>")))))


def primary_source(sources: Column) -> Column:
    """The first primary source, else the first, else null."""
    return F.coalesce(F.get(F.filter(sources, lambda s: s["is_primary"]), F.lit(0)), F.get(sources, F.lit(0)))


def title(company: str, authority: str, date: str) -> Column:
    known = F.when((T.filled(authority) != "") & (F.lower(T.filled(authority)) != "unknown"), F.col(authority))
    return F.concat_ws(" — ", F.nullif(T.filled(company), F.lit("")), known, F.nullif(F.left(T.filled(date), F.lit(4)), F.lit("")))


def events(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Rows as events: normal date, tier, sources, primary source, title, year, section label, slug and path. rows: id, company, authority, date, ... , listed.

    Slugs are distinct: a stored one (column `slug`, if there is one) stays, the others are numbered in order of arrival_idx.
    """
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    out = rows.withColumn("date", dates.normalize_date("date")).withColumn("sources", collect_sources(F.col("official_source_url"), F.col("listed"), F.col("source_url")))
    tier = verification.tier("stored_tier", "official_source_url", "source_url")
    listed = F.when((tier == "ai") & (F.size("sources") > 0), "press").otherwise(tier)
    out = out.withColumns(
        {
            "trust_tier": listed,
            "primary_url": primary_source(F.col("sources"))["url"],
            "title": title("company", "authority", "date"),
            "year": F.left("date", F.lit(4)),
            "section_label": F.coalesce(F.try_element_at(label, F.col("section")), F.lit("Enforcement")),
            "_base": T.case_slug("company", "authority", "date"),
            "_stored": F.col("slug") if "slug" in rows.columns else F.lit(None).cast("string"),
            "updated_at": F.left(F.col("updated_at").cast("string"), F.lit(10)) if "updated_at" in rows.columns else F.lit(""),
        }
    )
    out = clustering.unique_slugs(out.drop("slug"), "_base", "arrival_idx", "_stored" if "slug" in rows.columns else None).drop("_base", "_stored")
    return out.withColumn("url_path", F.concat(F.lit("enforcement/"), "slug"))


def csv_rows(found: DataFrame) -> DataFrame:
    """The export's fifteen columns; sources joined by bars."""
    names = ["id", "date", "section", "authority", "company", "sector", "violation_type", "dpdpa_section", "penalty_amount", "penalty_amount_inr", "outcome", "trust_tier", "source_url"]
    return found.select(*names, F.array_join(F.transform("sources", lambda s: s["url"]), " | ").alias("sources"), "url_path")


def heuristic_record(items: DataFrame) -> DataFrame:
    """The fixed extraction record of items with an enforcement word; the first amount of money as written."""
    both = F.concat_ws(" ", T.filled("title"), T.filled("summary"))
    found = items.where(F.lower(both).rlike(L.ENFORCEMENT_SIGNAL))
    return found.withColumns(
        {
            "is_genuine_enforcement": F.lit(True),
            "x_authority": F.lit("Unknown"),
            "x_company": F.lit(L.NEEDS_REVIEW_SOURCE),
            "x_sector": T.sector_of(F.lower(both)),
            "x_violation": F.lit(L.AUTO_FLAGGED),
            "x_penalty": F.trim(F.regexp_extract(both, L.EXTRACTED_MONEY, 0)),
            "x_outcome": F.lit("Investigation Ongoing"),
            "x_summary": F.concat(F.lit(L.AUTO_DETECTED), T.filled("title"), F.lit(f". {L.SNIPPET}"), F.left(T.filled("summary"), F.lit(280))),
            "x_confidence": F.lit("low"),
        }
    )


def candidate_rows(extracted: DataFrame, as_of: Column) -> DataFrame:
    """Extracted items as case rows: section by the authority's map, else by rule; sector unless Other, else by rule; confidence by an official URL.

    The date is the item's, else that of the run. The id is of the run's year and the URL's hash, so that a repeated run gives the same rows. Columns that are
    missing count as empty; what was extracted is kept whole beside them.
    """
    value = lambda c: T.filled(c) if c in extracted.columns else F.lit("")
    id_ = F.concat(F.lit("AUTO-"), F.date_format(as_of, "yyyy"), F.lit("-"), F.upper(F.left(F.md5(T.filled("url").cast("binary")), F.lit(8))))
    text = F.concat_ws(" ", T.filled("title"), T.filled("x_summary"), T.filled("x_violation"))
    known = F.create_map(*[F.lit(x) for kv in L.AUTHORITY_SECTION.items() for x in kv])
    sector = F.when((T.filled("x_sector") != "") & (F.col("x_sector") != "Other"), F.col("x_sector")).otherwise(T.sector_of(text))
    strong = F.when(T.filled("official_url") != "", "high").otherwise(F.coalesce(F.nullif(F.col("x_confidence"), F.lit("")), F.lit("medium")))
    return extracted.select(
        "arrival_idx",
        F.coalesce(F.try_element_at(known, F.col("x_authority")), T.section_of(text, "x_authority")).alias("section"),
        F.coalesce(F.nullif(F.col("x_authority"), F.lit("")), F.lit("Unknown")).alias("authority"),
        F.coalesce(F.nullif(F.col("x_company"), F.lit("")), F.lit(L.NEEDS_REVIEW)).alias("company"),
        sector.alias("sector"),
        F.lit(True).alias("needs_review"),
        strong.alias("confidence"),
        F.col("url").alias("source_url"),
        id_.alias("id"),
        F.coalesce(F.nullif(value("published"), F.lit("")), F.date_format(as_of, "yyyy-MM-dd")).alias("date"),
        value("x_violation").alias("violation_type"),
        value("x_section").alias("dpdpa_section"),
        F.coalesce(F.nullif(value("x_summary"), F.lit("")), value("summary")).alias("summary"),
        value("x_penalty").alias("penalty_amount"),
        F.coalesce(F.col("x_penalty_inr").cast("double") if "x_penalty_inr" in extracted.columns else F.lit(None), F.lit(0.0)).alias("penalty_amount_inr"),
        value("x_outcome").alias("outcome"),
        value("official_url").alias("official_source_url"),
        F.lit(True).alias("auto_detected"),
        F.to_json(F.struct(*[F.col(c) for c in extracted.columns if c.startswith("x_")])).alias("extracted"),
    )


def watch_query(name: Column | str) -> Column:
    return F.concat(F.lit('"'), T.col(name), F.lit(f'" {L.WATCH_ANCHOR}'))


def watch_list(entities: DataFrame, most: int = 40) -> DataFrame:
    """(name, kind, url, domain, at) of entities to watch: companies as first seen, then regulators and courts of more than one event; each name once, `most` in all.

    entities: name, entity_type, slug, first_seen, n_events.
    """
    level = F.when(F.col("entity_type") == "company", 0).when(F.col("entity_type").isin("regulator", "court") & (F.col("n_events") > 1), 1)
    low = F.lower(F.trim("name"))
    fit = entities.withColumns({"_level": level, "_low": low}).where(F.col("_level").isNotNull() & (F.length("_low") >= 4) & ~F.col("_low").isin(L.WATCH_SKIPPED))
    first = fit.groupBy("_low").agg(F.min_by(F.struct(F.trim("name").alias("name"), "slug", "_level", "first_seen"), F.struct("_level", "first_seen")).alias("f")).select("f.*")
    top = first.orderBy("_level", "first_seen").limit(most)
    top = top.withColumn("at", F.row_number().over(Window.orderBy("_level", "first_seen")))
    return top.select(F.concat(F.lit("Watch: "), "name").alias("name"), F.lit("gnews").alias("kind"), watch_query("name").alias("url"), F.col("slug").alias("domain"), "at")


def is_trusted(url: Column | str) -> Column:
    return T.any_of(T.filled(url), L.TRUSTED_DOMAINS)


def is_aggregator(url: Column | str) -> Column:
    return T.any_of(T.filled(url), L.AGGREGATOR_HOSTS)


def official_query(company: str, authority: str, keywords: str) -> Column:
    """The search text for an official source: the authority's own sites, else the first six trusted ones."""
    clause = lambda sites: " OR ".join(f"site:{d}" for d in sites)
    known = F.create_map(*[F.lit(x) for k, v in L.AUTHORITY_DOMAINS.items() for x in (k, clause(v))])
    sites = F.coalesce(F.try_element_at(known, T.filled(authority)), F.lit(clause(L.TRUSTED_DOMAINS[:6])))
    who = F.when(F.contains(F.lower(T.filled(company)), F.lit("review")), "").otherwise(T.filled(company))
    return F.trim(F.concat(F.lit("("), sites, F.lit(") "), who, F.lit(" "), T.filled(keywords)))


def feed_url(base: str, query: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(query))


def independent(sources: Column) -> Column:
    return urls.independent_sources(F.transform(sources, lambda s: s["url"]))
