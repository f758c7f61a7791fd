"""Relevance scoring with an itemised breakdown whose points add up to the score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import lexicons as L
from ..functions import text as T


def _when(test: Column, points: int) -> Column:
    return F.when(test, points).otherwise(0)


def signals(tracked: list[str] | None = None) -> list[tuple[str, Column, Column]]:
    """(name, points, detail) over the columns of `prepared`."""
    t, s = F.col("_t"), F.col("_s")
    none = F.lit("")
    judicial = T.any_of(s, L.JUDICIAL_SOURCES)
    out = [
        ("high_keywords", 2 * T.count_of(t, L.HIGH_KEYWORDS), T.hits(t, L.HIGH_KEYWORDS)),
        ("medium_keywords", T.count_of(t, L.MEDIUM_KEYWORDS), T.hits(t, L.MEDIUM_KEYWORDS)),
        ("origin", _when(T.any_of(s, L.ORIGIN_SOURCES), 2), T.hits(s, L.ORIGIN_SOURCES)),
        ("money", _when(t.rlike(L.MONEY), 3), F.regexp_extract(t, L.MONEY, 0)),
        ("enterprise", _when(T.any_of(t, L.ENTERPRISES) | t.rlike(L.CORPORATE_NAME), 2), T.hits(t, L.ENTERPRISES)),
        ("citation", _when(t.rlike(L.CITATION) | F.contains(t, F.lit("schedule i")), 2), F.regexp_extract(t, L.CITATION, 0)),
        ("enforcement", _when(T.any_of(t, L.ENFORCEMENT_VERBS), 2), T.hits(t, L.ENFORCEMENT_VERBS)),
        ("urgency", _when(T.any_of(t, L.URGENCY), 2), T.hits(t, L.URGENCY)),
        ("regulator_statute", _when((F.contains(s, F.lit("rbi")) | F.contains(t, F.lit("reserve bank"))) & F.contains(t, F.lit("dpdpa")), 3), none),
        ("authority_source", F.when(T.any_of(s, L.AUTHORITY_TWO), 2).when(T.any_of(s, L.AUTHORITY_ONE), 1).otherwise(0), none),
        ("judicial_source", F.when(judicial & t.rlike(L.SECTION_OR_RULE), 5).when(judicial, 4).otherwise(0), T.hits(s, L.JUDICIAL_SOURCES)),
        ("press_source", _when(T.any_of(s, L.PRESS_SOURCES), 2), T.hits(s, L.PRESS_SOURCES)),
        ("proceeding", _when(T.any_of(t, L.PROCEEDINGS), 3), T.hits(t, L.PROCEEDINGS)),
    ]
    if tracked:
        out.append(("tracked_entity", _when(T.any_of(t, sorted(tracked)), 4), T.hits(t, sorted(tracked))))
    return out


def prepared(items: DataFrame, as_of: Column) -> DataFrame:
    """Folded text and source and the age, computed once for all signals."""
    text = F.lower(F.concat_ws(" ", T.filled("title"), T.filled("summary")))
    return items.withColumns({"_t": text, "_s": F.lower(T.filled("source")), "_d": dates.days_old("published", as_of)})


def recency() -> Column:
    d, court = F.col("_d"), T.any_of(F.col("_s"), L.COURT_SOURCES)
    other = F.when(d <= 7, 3).when(d <= 30, 1).when(d <= 90, 0).when(d <= 180, -3).otherwise(-6)
    return F.when(court, F.when(d <= 30, 3).when(d <= 180, 0).when(d <= 730, -2).otherwise(-4)).otherwise(other)


def score(items: DataFrame, as_of: Column, tracked: list[str] | None = None, cap: int = 20) -> DataFrame:
    """Adds `score`: the signals up to the cap, and the recency."""
    total = reduce(lambda a, b: a + b, (p for _, p, _ in signals(tracked)))
    return prepared(items, as_of).withColumn("score", (F.least(F.lit(cap), total) + recency()).cast("int")).drop("_t", "_s", "_d")


def breakdown(items: DataFrame, as_of: Column, tracked: list[str] | None = None, cap: int = 20) -> DataFrame:
    """Adds `signals`, array<struct(signal, points, detail)> of those that fired, with the cap's cut and the recency; they add up to the score."""
    rows = signals(tracked)
    total = reduce(lambda a, b: a + b, (F.col(f"_p_{n}") for n, _, _ in rows))
    row = lambda n, p, d: F.struct(F.lit(n).alias("signal"), p.cast("int").alias("points"), d.alias("detail"))
    # looked up for those that fired alone, which are few
    all_ = [row(n, F.col(f"_p_{n}"), F.when(F.col(f"_p_{n}") != 0, d)) for n, _, d in rows] + [row("cap", F.least(F.lit(0), F.lit(cap) - total), F.lit("")), row("recency", recency(), F.lit(""))]
    out = prepared(items, as_of).withColumns({f"_p_{n}": p for n, p, _ in rows})
    return out.withColumn("signals", F.filter(F.array(*all_), lambda s: s["points"] != 0)).select(*items.columns, "signals")


def fired(items: DataFrame, as_of: Column, tracked: list[str] | None = None, cap: int = 20) -> DataFrame:
    """The items with a row (signal, points, detail) for each signal of `breakdown`; items without any have none."""
    # an inner explode would have Spark filter on the size of `signals` below it, with every signal and the age written out anew for each use
    rows = breakdown(items, as_of, tracked, cap).withColumn("_s", F.explode_outer("signals"))
    return rows.where(F.col("_s").isNotNull()).select(*items.columns, "_s.*")
