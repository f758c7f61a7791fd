"""Orders, counters, logs and reports over state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from . import verification


def registry_stats(sources: DataFrame) -> DataFrame:
    """(kind, tier, n, n_primary, level): totals by kind, by tier and over all. sources: kind, tier, is_primary."""
    sets = sources.groupingSets([("kind",), ("tier",), ()], "kind", "tier")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_primary").alias("n_primary"), F.grouping_id().cast("int").alias("level"))


def enabled(sources: DataFrame, tier: int | None = None, up_to: int | None = None) -> DataFrame:
    test = F.col("enabled")
    test = test & (F.col("tier") == tier) if tier is not None else test
    return sources.where(test & (F.col("tier") <= up_to) if up_to is not None else test)


def watch_entities(entities: DataFrame, skip: list[str], cap: int = 40) -> DataFrame:
    """Companies first, then regulators of more than one event: names of four signs or more, not skipped, once each by lower case."""
    kind = F.when(F.col("entity_type") == "company", 0).when((F.col("entity_type") == "regulator") & (F.col("n_events") > 1), 1)
    rows = entities.withColumn("_o", kind).where(F.col("_o").isNotNull() & (F.length("name") >= 4) & ~F.lower("name").isin(skip))
    first = rows.groupBy(F.lower("name").alias("_k")).agg(F.min_by(F.struct("name", "entity_type", "n_events"), F.struct("_o", "name")).alias("r"), F.min("_o").alias("_o"))
    return first.orderBy("_o", F.desc("r.n_events"), "r.name").limit(cap).select("r.*")


def oldest_evidence(evidence: DataFrame) -> DataFrame:
    """The oldest row of each action, as a variant of the strongest; of rows of one arrival and URL the strongest, however they are dealt out."""
    order = F.struct("arrival", "url", -verification.strength_rank(), "strength")
    return evidence.groupBy("action_id").agg(F.min_by(F.struct("url", "strength"), order).alias("b")).select("action_id", "b.*")


def entity_events(edges: DataFrame) -> DataFrame:
    """(entity, event_id): each event once, whether the entity is its subject or an authority."""
    return edges.select("entity", "event_id").distinct()


def entity_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities with their count of events, 0 without one; the most first."""
    n = entity_events(edges).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return entities.join(n, "entity", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def graph_counters(cases: DataFrame, entities: DataFrame, contradictions: DataFrame) -> DataFrame:
    """One row: events, entities, companies, regulators (and courts), contradictions."""
    e = entities.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("entity_type") == "company").alias("companies"), F.count_if(F.col("entity_type").isin("regulator", "court")).alias("regulators"))
    one = cases.agg(F.count(F.lit(1)).alias("events")).crossJoin(F.broadcast(e))
    return one.crossJoin(F.broadcast(contradictions.agg(F.count(F.lit(1)).alias("contradictions"))))


def related_in_group(rows: DataFrame, group: str, key: str, order: str, most: int = 4) -> DataFrame:
    """(key, related, rank): others of the same group, the first `most` in the list's order. Each group is cut to most + 1 rows before it is joined."""
    w = Window.partitionBy(group).orderBy(order, key)
    top = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 1).select(group, F.col(key).alias("related"), F.col("_n"))
    both = rows.select(group, key).join(top, group).where(F.col(key) != F.col("related"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_n")))
    return ranked.where(F.col("rank") <= most).select(key, "related", "rank")


def health_totals(health: DataFrame) -> DataFrame:
    return health.agg(F.count_if(F.col("status").isin("ok", "fallback")).alias("healthy"), F.count_if(~F.col("status").isin("ok", "fallback")).alias("dark"), F.sum("items").alias("items"))


def gap_summary(items: DataFrame, column: str, words: list[str]) -> DataFrame:
    """One row: crawled, with a gap, and the distinct first keywords in order."""
    low = F.lower(T.filled(column))
    first = F.get(F.filter(T.strings(words), lambda w: F.contains(low, w)), F.lit(0))
    return items.withColumn("_g", first).agg(F.count(F.lit(1)).alias("crawled"), F.count("_g").alias("gaps"), F.array_join(F.array_sort(F.collect_set("_g")), ",").alias("keywords"))


def run_log(runs: DataFrame) -> DataFrame:
    return runs.select("job", "status", F.left(T.filled("detail"), F.lit(500)).alias("detail"), F.coalesce("items_found", F.lit(0)).alias("items_found"))


def trace_order(found: DataFrame, most: int = 1200) -> DataFrame:
    """Candidates, then deferred, then the rest; by true score within; a top-k."""
    place = F.when(F.col("verdict") == "candidate", 0).when(F.col("verdict") == "deferred", 1).otherwise(2)
    return found.orderBy(place, F.desc("score"), "arrival_idx").limit(most)


def seen_cache(seen: DataFrame, most: int = 20_000) -> DataFrame:
    """The URLs seen last."""
    return seen.groupBy("url").agg(F.max("last_seen").alias("last_seen")).orderBy(F.desc("last_seen"), "url").limit(most)


def score_badge(score: Column) -> Column:
    return F.when(score >= 12, "high").when(score >= 8, "medium").otherwise("low")


def time_ago(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))


def decision_texts(rows: DataFrame) -> DataFrame:
    """Title and snippet of a decision on an automatic summary: what stands before and after its marker, 200 and 500 signs at most."""
    parts = F.split(T.filled("summary"), L.SNIPPET, 2)
    head = F.regexp_replace(F.get(parts, F.lit(0)), f"^{L.AUTO_DETECTED}", "")
    return rows.select("arrival_idx", F.left(head, F.lit(200)).alias("title"), F.left(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit(500)).alias("snippet"))


def guarded_text(text: Column, fallback: Column, least: int = 200) -> Column:
    """The text if it is long enough, else the fallback, else the text."""
    return F.when(F.length(T.filled(text)) >= least, text).otherwise(F.coalesce(F.nullif(fallback, F.lit("")), text, F.lit("")))


def angles(stories: DataFrame, least: int = 8, most: int = 8) -> DataFrame:
    """The template angle of the top stories."""
    top = stories.where(F.col("score") >= least).orderBy(F.desc("score"), "story_id").limit(most)
    return top.select("story_id", F.concat(F.lit("What it means: "), "headline").alias("angle"))


def llms_lines(cases: DataFrame, base: str) -> DataFrame:
    return cases.select(F.concat(F.lit("- ["), "title", F.lit(f"]({base}/"), "url_path", F.lit(")")).alias("value"))


def statute_sections(spark: SparkSession) -> DataFrame:
    """(number, title, chapter, place) of the listed sections."""
    rows = [(n, t, c, k) for k, (n, (t, c)) in enumerate(L.STATUTE_SECTIONS.items())]
    return spark.createDataFrame(rows, "number string, title string, chapter string, place int")


def statute_pages(cases: DataFrame, most: int = 4) -> DataFrame:
    """A row of each listed section: label, title, chapter, path, how many cases cite it, the latest one, and the first others of its chapter.

    cases: id, date, dpdpa_section. The table of sections has a fixed size and is broadcast.
    """
    sections = statute_sections(cases.sparkSession)
    cited = cases.select("id", "date", F.explode(T.citations("dpdpa_section")).alias("number"))
    counts = cited.groupBy("number").agg(F.count(F.lit(1)).alias("n_cases"), F.min_by("id", F.struct(F.col("date").isNull(), (-F.unix_date(F.to_date("date"))), "id")).alias("latest"))
    near = related_in_group(sections, "chapter", "number", "place", most).groupBy("number").agg(F.array_sort(F.collect_list(F.struct("rank", "related"))).alias("r"))
    pages = F.broadcast(sections).join(counts, "number", "left").join(F.broadcast(near), "number", "left")
    return pages.select(
        F.concat(F.lit("Section "), "number").alias("label"),
        "title",
        "chapter",
        F.concat(F.lit("dpdpa/section-"), "number").alias("path"),
        F.coalesce("n_cases", F.lit(0).cast("long")).alias("n_cases"),
        "latest",
        F.coalesce(F.array_join(F.transform("r", lambda x: x["related"]), ","), F.lit("")).alias("related"),
    )


def chosen(rows: DataFrame, choices: dict[str, str | None]) -> DataFrame:
    """The rows that have each chosen category; a choice that is empty or null leaves all."""
    for column, value in choices.items():
        if value:
            rows = rows.where(F.col(column) == value)
    return rows


def seeded(rows: DataFrame, now: Column) -> DataFrame:
    """Curated rows as verified cases: constants of confidence and review, times of now, and the standing note where a row has none."""
    note = F.lit("Curated baseline — verify against source.")
    constants = {"auto_detected": F.lit(False), "needs_review": F.lit(False), "confidence": F.lit("high"), "detected_at": now, "verified_at": now, "updated_at": now}
    return rows.withColumns(constants | {"notes": F.coalesce("notes", note) if "notes" in rows.columns else note})


def unrecorded(items: DataFrame, recorded: DataFrame) -> DataFrame:
    """The items whose URL is no recorded case's source."""
    return items.join(recorded.select("url").distinct(), "url", "left_anti")
