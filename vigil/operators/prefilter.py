"""The relevance pre-filter, ranking, spend cap and funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T


def verdict(items: DataFrame, primary: list[str], always: list[str]) -> DataFrame:
    """Adds keep, reason and priority; a source is primary or always relevant if a listed domain is part of its name or URL."""
    folded = {"_title": F.lower(T.filled("title")), "_t": F.lower(F.concat_ws(" ", T.filled("title"), T.filled("summary"))), "_where": F.concat_ws(" ", T.filled("source"), T.filled("url"))}
    title, t, where = map(F.col, folded)
    is_primary = T.any_of(where, primary) if primary else F.lit(False)
    is_always = T.any_of(where, always) if always else F.lit(False)
    anchored, in_title = T.any_of(t, L.ANCHORS), T.any_of(title, L.ANCHORS)
    reason = (
        F.when(F.trim(title) == "", "empty_title")
        .when(t.rlike(L.NOISE), "noise_pattern")
        .when(t.rlike(L.OFF_TOPIC) & ~in_title, "off_topic_regulatory")
        .when(t.rlike(L.CORPORATE_NOISE) & ~in_title, "corporate_noise")
        .when(~anchored & ~is_always, "no_topic_anchor")
        .otherwise("kept")
    )
    points = lambda test, n: F.when(test, n).otherwise(0)
    hinted = T.any_of(t, L.COUNTRY_HINTS) | T.any_of(F.lower(T.filled("source")), L.COUNTRY_HINTS)
    priority = points(is_primary, 5) + points(anchored, 2) + points(t.rlike(L.ACTIONS), 3) + points(hinted, 2) + points(t.rlike(L.MONEY_HINT), 2)
    out = items.withColumns(folded).withColumn("reason", reason)
    return out.withColumns({"keep": F.col("reason") == "kept", "priority": F.when(F.col("reason") == "kept", priority).otherwise(0).cast("int")}).drop(*folded)


def histogram(judged: DataFrame) -> DataFrame:
    """Rejections by reason."""
    return judged.where(~F.col("keep")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def first_per(rows: DataFrame, key: str, order: list[Column | str], count: str | None = None) -> DataFrame:
    """The first row of each key in the given order, and the key's count of rows if it is named; by one aggregation: a hot key is no task's whole load."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    counts = [F.count(F.lit(1)).alias(count)] if count else []
    return rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(packed, F.struct(*order)).alias("_r"), *counts).select("_r.*", *([count] if count else []))


def candidates(scored: DataFrame, cap: int = 15) -> DataFrame:
    """The `cap` best of the kept items with their rank: score, then fresh before carried, then priority, then arrival.

    A top-k: each task keeps `cap` rows, which meet in one.
    """
    order = [F.desc("score"), F.asc("carried"), F.desc("priority"), F.asc("arrival_idx")]
    top = scored.orderBy(*order).limit(cap)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def deferred(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rest of the kept items; chosen: at most the cap."""
    return scored.join(F.broadcast(chosen.select("arrival_idx")), "arrival_idx", "left_anti")


def funnel(stages: DataFrame, order: list[str]) -> DataFrame:
    """stages: one column of flags for each stage, nested. Count, drop from the one before and share of the first."""
    return funnel_of(stages.agg(*[F.count_if(F.col(c)).alias(c) for c in order]), order)


def funnel_of(counts: DataFrame, order: list[str]) -> DataFrame:
    """The same of one row of counts."""
    rows = counts.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n")) for c in order])).alias("stage_no", "s")).select("stage_no", "s.stage", "s.n")
    w = Window.orderBy("stage_no")  # as many rows as stages
    first = F.first("n").over(w)
    return rows.withColumns({"dropped": F.coalesce(F.lag("n").over(w) - F.col("n"), F.lit(0)).cast("long"), "pct": F.round(F.when(first > 0, 100.0 * F.col("n") / first).otherwise(0.0), 2)})
