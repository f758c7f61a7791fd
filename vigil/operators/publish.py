"""Aggregates and artifacts of published cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T


def snapshot_stats(cases: DataFrame) -> DataFrame:
    section = F.when(F.col("section").isin(L.SECTIONS), F.col("section")).otherwise(L.SECTION_DEFAULT)
    return cases.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(section == s).alias(s) for s in L.SECTIONS])


def sector_buckets(cases: DataFrame) -> DataFrame:
    bucket = None
    for name, sectors in L.SECTOR_BUCKETS:
        test = F.col("sector").isin(sectors)
        bucket = F.when(test, name) if bucket is None else bucket.when(test, name)
    return cases.groupBy(bucket.otherwise("other_count").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def site_stats(cases: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """Total, confirmed by a primary source, first year, and a count of each section asked for (total_<section>)."""
    year = F.left("date", F.lit(4))
    per = [F.count_if(F.col("section") == s).alias(f"total_{s}") for s in sections or []]
    return cases.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("trust_tier") == "primary").alias("primary_confirmed"), F.min(F.when(year.rlike(r"^\d{4}$"), year)).alias("since"), *per
    )


def counts_map(counts: DataFrame, key: str, value: str, order: list) -> DataFrame:
    """(m): a short table of counts as one map, in order."""
    entry = F.struct(F.struct(*order).alias("o"), F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("e"))
    return counts.agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"])).alias("m"))


def api_stats(cases: DataFrame, sections: list[str]) -> DataFrame:
    """One row: totals, and counts by section (all asked for), authority and sector (the top ones of penalties_by)."""
    total = site_stats(cases, sections).crossJoin(F.broadcast(cases.agg(F.round(F.sum(F.coalesce("penalty_amount_inr", F.lit(0.0))), 2).alias("total_penalty_inr"))))
    by_section = F.map_from_arrays(F.array(*map(F.lit, sections)), F.array(*[F.col(f"total_{s}") for s in sections]))
    out = total.select(F.col("total").alias("total_cases"), "primary_confirmed", "total_penalty_inr", by_section.alias("by_section"))
    for key in ("authority", "sector"):
        top = counts_map(penalties_by(cases, key), "name", "n", [F.col("rank")])
        out = out.crossJoin(F.broadcast(top.withColumnRenamed("m", f"by_{key}")))  # one row each
    return out


def sweep_stats(raw: DataFrame, health: DataFrame, judged: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of a sweep's counts. raw: (state) of each item: seen, duplicate or fresh; health: (status); judged: (keep, reason, carried); chosen: (url), the candidates."""
    fine = F.col("status").isin("ok", "fallback")
    n = lambda test, name: F.count_if(test).alias(name)
    a = health.agg(F.count(F.lit(1)).alias("sources_polled"), n(fine, "sources_healthy"), n(~fine, "sources_dark"))
    b = raw.agg(F.count(F.lit(1)).alias("raw_items"), n(F.col("state") == "seen", "already_seen"), n(F.col("state") == "duplicate", "near_duplicates"))
    reasons = counts_map(judged.where("NOT keep").groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "reason", "n", [F.col("reason")])
    c = judged.agg(n(~F.col("keep"), "prefilter_rejected"), n(F.col("keep"), "kept"), n(F.col("keep") & F.col("carried"), "carried_from_backlog"))
    d = chosen.agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct(F.nullif("url", F.lit(""))).alias("new_urls"))
    out = a
    for part in (b, c, d, reasons.withColumnRenamed("m", "rejection_reasons")):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out.withColumns({"deferred_to_backlog": F.col("kept") - F.col("candidates"), "paid_api_calls": F.lit(0)})


def penalties_by(cases: DataFrame, key: str, top_k: int = 8) -> DataFrame:
    """Count, total and a bar of 4 to 100 per cent of the highest, for the top keys."""
    name = F.coalesce(F.nullif(F.trim(T.filled(key)), F.lit("")), F.lit("Unknown"))
    grouped = cases.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("penalty_amount_inr", F.lit(0.0))), 2).alias("total_inr"))
    order = [F.desc("total_inr"), F.desc("n"), F.asc("name")]
    top = grouped.orderBy(*order).limit(top_k)
    w = Window.orderBy(*order)  # top_k rows
    best, most = F.first("total_inr").over(w), F.first("n").over(w)
    share = F.when((best > 0) & (F.col("total_inr") > 0), F.floor(F.col("total_inr") / best * 100)).otherwise(F.greatest(F.lit(8), F.floor(F.col("n") / F.greatest(F.lit(1), most) * 100)))
    return top.withColumns({"pct": F.greatest(F.lit(4), F.least(F.lit(100), share)).cast("int"), "rank": F.row_number().over(w)})


def by_year(cases: DataFrame) -> DataFrame:
    year = F.left("date", F.lit(4))
    n = cases.where(year.rlike(r"^\d{4}$")).groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n"))
    peak = n.agg(F.max("n").alias("peak"))
    return n.crossJoin(F.broadcast(peak)).select("year", "n", F.greatest(F.lit(6), F.floor(F.col("n") / F.col("peak") * 100)).cast("int").alias("pct"))


def largest(cases: DataFrame, k: int = 10) -> DataFrame:
    return cases.where("penalty_amount_inr > 0").orderBy(F.desc("penalty_amount_inr"), "id").limit(k).select("id", "company", "penalty_amount_inr")


def tier_shares(cases: DataFrame) -> DataFrame:
    n = cases.groupBy("trust_tier").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("trust_tier", "n", F.round(100.0 * F.col("n") / F.col("all"), 2).alias("pct"))


def most_common(cases: DataFrame, key: str, k: int = 4) -> DataFrame:
    """The k most frequent values that are not blank; ties by first arrival."""
    n = cases.where(F.trim(T.filled(key)) != "").groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("arrival_idx").alias("first"))
    return n.orderBy(F.desc("n"), "first").limit(k).select("value", "n")


def classifier_metrics(rows: DataFrame) -> DataFrame:
    """rows: gold, predicted (booleans). Zero where a ratio has no cases."""
    g, p = F.col("gold"), F.col("predicted")
    c = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(~g & ~p).alias("tn"), F.count_if(g & ~p).alias("fn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 3)
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + tn + fn)})


def related_cases(cases: DataFrame, most: int = 4) -> DataFrame:
    """Cases of the same authority first, then of the same sector, without the case itself; the latest `most` of each.

    Every case needs only the latest few of its authority and sector, so each key is cut to most + 1 rows before it is joined.
    """

    def latest(key: str, level: int) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.desc("date"), "id")
        top = cases.where(T.filled(key) != "").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * most + 1)
        top = top.select(key, F.col("id").alias("related"), F.col("date").alias("related_date"), F.lit(level).alias("level"))
        return cases.select("id", key).join(top, key).where("id <> related").drop(key)

    both = latest("authority", 0).unionByName(latest("sector", 1))
    one = both.groupBy("id", "related").agg(F.min("level").alias("level"), F.first("related_date").alias("related_date"))
    w = Window.partitionBy("id").orderBy("level", F.desc("related_date"), "related")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("id", "related", "level", "rank")


def csv_rows(cases: DataFrame) -> DataFrame:
    columns = [c for c in ("id", "date", "section", "authority", "company", "sector", "violation_type", "dpdpa_section", "penalty_amount", "penalty_amount_inr", "outcome", "trust_tier", "source_url") if c in cases.columns]
    return cases.select(*columns)


def api_documents(cases: DataFrame) -> DataFrame:
    """(path, body): a JSON document of each case; nulls are left out."""
    return cases.select(F.format_string("cases/%s.json", F.col("id").cast("string")).alias("path"), F.to_json(F.struct(*sorted(cases.columns))).alias("body"))
