"""Keyed writes, lifecycles, retention, backlog and visibility over state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def upsert(old: DataFrame, new: DataFrame, keys: list[str], ignore: bool = False, order: str | None = None) -> DataFrame:
    """Rows of both by key: with `ignore` the old row stays, else the new one's values that are not null replace the old one's.

    Of several new rows of one key the first counts with `ignore`, else the last; by the column `order`, else by all their values.
    """
    rest = [c for c in old.columns if c not in keys]
    own = [c for c in rest if c in new.columns]
    pick = F.min_by if ignore else F.max_by
    new = new.groupBy(*keys).agg(pick(F.struct(*own), F.col(order) if order else F.struct(*own)).alias("_new")) if own else new.select(*keys).distinct().withColumn("_new", F.struct())
    if ignore:
        return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*keys, "_new.*"), allowMissingColumns=True)
    a = old.select(*keys, F.struct(*rest).alias("_old"))
    value = lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")) if c in own else F.col(f"_old.{c}")
    return a.join(new, keys, "full").select(*keys, *[value(c).alias(c) for c in rest])


def update(table: DataFrame, test: Column, patch: dict[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in patch.items()})


def delete(table: DataFrame, test: Column) -> DataFrame:
    """Rows for which the test is not true; null is not true."""
    return table.where(~F.coalesce(test, F.lit(False)))


def lifecycle(decisions: DataFrame) -> DataFrame:
    """The state after the last decision of each id. decisions: (id, action, decided_at)."""
    last = decisions.groupBy("id").agg(F.max_by("action", F.struct("decided_at", "action")).alias("action"), F.count(F.lit(1)).alias("n_decisions"))
    state = F.when(F.col("action") == "verify", "published").when(F.col("action") == "unpublish", "unpublished").when(F.col("action") == "discard", "discarded").otherwise("needs_review")
    return last.withColumn("state", state)


def false_positive_filter(rows: DataFrame, decisions: DataFrame, recent: int = 200) -> DataFrame:
    """Rows whose signature was not discarded in the most recent decisions. The list is bounded by `recent`."""
    bad = decisions.where("action = 'discard'").orderBy(F.desc("decided_at"), "signature").limit(recent).select("signature").distinct()
    return rows.withColumn("signature", T.signature("company", "authority")).join(F.broadcast(bad), "signature", "left_anti")


def prune(stories: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return stories.where(F.col("processed_at") >= F.date_sub(as_of, days))


def carry_backlog(backlog: DataFrame, seen: DataFrame, kept: DataFrame, as_of: Column, age: int = 21, size: int = 600) -> DataFrame:
    """Queued items young enough, neither seen nor among those kept now; the oldest `size` by arrival."""
    young = backlog.where(F.col("queued_at") >= F.date_sub(as_of, age))
    return young.join(seen.select("url"), "url", "left_anti").join(kept.select("url"), "url", "left_anti").orderBy("arrival_idx").limit(size)


def visible(table: DataFrame, role: str) -> DataFrame:
    """Row-level visibility: anonymous readers see rows that need no review."""
    return table if role == "authenticated" else table.where(~F.col("needs_review"))


def open_cases(cases: DataFrame, as_of: Column, stale_days: int = 30, scan: int = 200, limit: int = 15) -> DataFrame:
    from ..functions import lexicons as L

    stale = F.col("last_checked").isNull() | (F.col("last_checked") <= F.date_sub(as_of, stale_days))
    order = [F.asc_nulls_first("last_checked"), F.asc("id")]
    return cases.where(F.col("outcome").isin(L.OPEN_OUTCOMES)).orderBy(*order).limit(scan).where(stale).orderBy(*order).limit(limit)
