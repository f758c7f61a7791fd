"""Briefs, watch lists, tracked terms, calendars, messages and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, lexicons
from ..functions import text as T
from . import publish


def brief(cases: DataFrame, period: str) -> DataFrame:
    """(period, body): the template brief; its parts are top-k aggregates of bounded size."""
    total = cases.agg(F.count(F.lit(1)).alias("n"), F.sum("penalty_amount_inr").alias("inr"))
    top = publish.most_common(cases, "authority").agg(F.array_join(F.collect_list(F.format_string("%s (%d)", "value", "n")), ", ").alias("authorities"))
    body = F.concat_ws("\n", F.format_string("# Brief %s", F.lit(period)), F.format_string("%d cases", "n"), F.concat(F.lit("Penalties: "), F.format_number("inr", 2)), F.concat(F.lit("Authorities: "), "authorities"))
    return total.crossJoin(top).select(F.lit(period).alias("period"), body.alias("body"))


def tracked_terms(entities: DataFrame, order: str, most: int | None = 60) -> DataFrame:
    """(term) of the first `most` entities (name, aliases), or of all if it is None: each name and alias of four signs or more, its first word that identifies, and the first two."""
    few = entities.where(F.trim(T.filled("name")) != "")
    if most is not None:
        few = few.orderBy(order).limit(most)
    said = few.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("v")).select(F.lower(F.trim("v")).alias("v"))
    words = F.filter(F.split(T.squeeze(F.regexp_replace("v", "[/-]", " ")), " "), lambda t: (F.length(t) >= 4) & ~F.array_contains(T.strings(lexicons.GENERIC_NAME_WORDS), t))
    both = said.select("v", words.alias("w"))
    terms = F.array(F.col("v"), F.get("w", F.lit(0)), F.when(F.size("w") >= 2, F.array_join(F.slice("w", 1, 2), " ")))
    return both.select(F.explode(F.array_compact(terms)).alias("term")).where(F.length("term") >= 4).distinct()


def calendar(curated: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Curated milestones and those of events on other dates, with days to go."""
    derived = events.where(F.length("date") >= 10).select("date", "title", F.left("description", F.lit(220)).alias("description"), F.lit(False).alias("curated"))
    derived = derived.join(curated.select("date").distinct(), "date", "left_anti")
    both = curated.select("date", "title", "description", F.lit(True).alias("curated")).unionByName(derived)
    away = dates.days_away("date", as_of)
    return both.withColumns({"days_away": away, "is_future": F.coalesce(away >= 0, F.lit(False))})


def few_shot(decisions: DataFrame, n: int = 6) -> DataFrame:
    """(block): the first n decisions as labelled lines."""
    top = decisions.orderBy("decided_at").limit(n)
    line = F.struct("decided_at", F.format_string("%s: %s", F.when(F.col("action") == "discard", "NOT A CASE").otherwise("CASE"), "title").alias("line"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("block"))


def alert_payload(stories: DataFrame, threshold: int = 12) -> DataFrame:
    return stories.where(F.col("score") >= threshold).select("story_id", F.to_json(F.struct(F.format_string("[%d] %s (%s)", "score", "headline", "source").alias("text"))).alias("payload"))


def robots(files: DataFrame) -> DataFrame:
    """files (url, body): agents, disallowed paths, and whether a site map is named."""
    every = lambda p: F.regexp_extract_all("body", F.lit(p), F.lit(1))
    return files.select("url", every(r"(?im)^user-agent:[ \t]*(\S+)").alias("agents"), every(r"(?im)^disallow:[ \t]*(\S+)").alias("disallowed"), F.col("body").rlike(r"(?im)^sitemap:").alias("sitemap"))


def deep_trace(candidates: DataFrame) -> DataFrame:
    """Ordered stages of each candidate and its outcome. candidates: text, extracted, false_positive, verified."""
    stage = lambda n, ok, d: F.struct(F.lit(n).alias("stage"), ok.alias("ok"), d.alias("detail"))
    long = F.length(T.filled("text")) >= 200
    stages = F.array(
        stage("fetch", long, F.length(T.filled("text")).cast("string")),
        stage("extract", F.col("extracted"), F.lit("")),
        stage("false_positive", ~F.col("false_positive"), F.lit("")),
        stage("verify", F.col("verified"), F.lit("")),
    )
    outcome = F.when(~long, "unfetched").when(~F.col("extracted"), "not_a_case").when(F.col("false_positive"), "known_false_positive").when(F.col("verified"), "verified").otherwise("needs_review")
    return candidates.withColumns({"stages": stages, "outcome": outcome})
