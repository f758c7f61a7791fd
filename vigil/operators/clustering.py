"""Event clustering with survivorship, and collision-free slugs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import scratch


def rank_of(confidence: str = "confidence"):
    """An unknown confidence ranks as low does, so the first of them stays."""
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ["low", 0, "medium", 1, "high", 2])), F.lower(F.col(confidence))), F.lit(0))


def cluster(rows: DataFrame) -> DataFrame:
    """One row of each cluster key.

    The first row by arrival is the base; the longest summary, the strongest confidence and the first official URL, penalty text,
    provision and violation that are not empty survive; sources are distinct by URL in order of arrival.
    """
    keyed = rows.withColumn("cluster_key", T.cluster_key("company", "authority", "date", "penalty_amount_inr"))
    first = lambda c: F.coalesce(F.min_by(c, F.when(T.filled(c) != "", F.col("arrival_idx"))), F.lit("")).alias(c)
    source = F.struct(F.col("arrival_idx").alias("at"), F.col("source_url").alias("url"))
    each = keyed.groupBy("cluster_key").agg(
        *[F.min_by(c, "arrival_idx").alias(c) for c in ("id", "company", "authority", "date", "penalty_amount_inr")],
        F.max_by("summary", F.struct(F.length(T.filled("summary")), -F.col("arrival_idx"))).alias("summary"),
        F.max_by("confidence", F.struct(rank_of(), -F.col("arrival_idx"))).alias("confidence"),
        *map(first, ("official_source_url", "penalty_amount", "dpdpa_section", "violation_type")),
        F.count(F.lit(1)).alias("merged"),
    )
    urls = keyed.where(T.filled("source_url") != "").groupBy("cluster_key", "source_url").agg(F.min("arrival_idx").alias("arrival_idx"))
    lists = urls.groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(source)), lambda s: s["url"]).alias("sources"))
    return each.join(lists, "cluster_key", "left")


def ranked(rows: DataFrame, key: str, order: str, name: str = "_n") -> DataFrame:
    """Adds the row's number (from 1) within its key, by a numeric order that is distinct within the key.

    Rows are numbered inside ranges of the order, whose bounds are quantiles of the table, and counts of the ranges before are added: a key that holds
    most rows is dealt to as many tasks as there are ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [i / parts for i in range(1, parts)] or [0.5]
    bounds = rows.agg(F.percentile_approx(F.col(order).cast("long"), F.array(*map(F.lit, at)), F.lit(10_000)).alias("q")).first()["q"]
    inside = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds or []))]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    placed = rows.withColumn("_range", inside)
    counts = placed.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "_range", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    own = placed.withColumn("_own", F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)))
    return own.join(counts, [key, "_range"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def numbered_slugs(rows: DataFrame, base: str, order: str, reserved: DataFrame | None = None) -> DataFrame:
    """Adds `slug`: the base, then base-2, base-3 ... in order, past reserved ones (slug) and past bases that end so themselves: all are distinct.

    The n-th row of a base gets the n-th number that is free. Of taken numbers t1 < t2 < ... those with t_j - j < n lie before it, so that it is
    n and their count; they are counted in the same order as the rows, and neither rows nor taken numbers of a base meet in one task.
    """
    numbered = ranked(rows, base, order)
    bases = rows.select(F.col(base).alias("_b")).distinct()
    taken = bases.select(F.col("_b").alias("s"), F.lit(False).alias("stored"))
    if reserved is not None:
        taken = taken.unionByName(reserved.select(F.col("slug").alias("s"), F.lit(True).alias("stored")))
    number = F.expr("try_cast(regexp_extract(s, '-([1-9][0-9]{0,8})$', 1) AS int)")
    ends = taken.select(F.regexp_extract("s", "^(.*)-[1-9][0-9]{0,8}$", 1).alias("_b"), number.alias("t")).where("t >= 2")
    whole = taken.where("stored").select(F.col("s").alias("_b"), F.lit(1).alias("t"))
    taken = scratch.stored(ends.unionByName(whole).distinct().join(bases, "_b", "left_semi"))
    slug = lambda k: F.when(k == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), k.cast("string")))
    if taken.isEmpty():
        return numbered.withColumn("slug", slug(F.col("_n"))).drop("_n")
    late = ranked(taken, "_b", "t").select(F.col("_b").alias(base), (2 * (F.col("t") - F.col("_n")) + 1).alias("_v"), F.lit(None).cast("long").alias("_row"))
    # taken numbers of one base may be equally late; they are told apart by their own order
    late = late.groupBy(base, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_row", F.lit(None).cast("long"))
    asked = numbered.select(base, (2 * F.col("_n")).alias("_v"), F.lit(0).alias("_c"), F.col("_n").cast("long").alias("_row"))
    both = _running(late.unionByName(asked), base, "_v", "_c")
    skip = both.where("_row IS NOT NULL").select(base, F.col("_row").alias("_n"), F.col("_sum").alias("_skip"))
    out = numbered.join(skip, [base, "_n"])
    return out.withColumn("slug", slug(F.col("_n") + F.col("_skip"))).drop("_n", "_skip")


def _running(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds `_sum`: the sum of `value` over the rows of the key up to this one; the order is distinct within the key. In ranges, as ranked()."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)] or [F.lit(0.5)]), F.lit(10_000)).alias("q")).first()["q"]
    inside = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    placed = rows.withColumn("_range", inside)
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(key, "_range").agg(F.sum(value).alias("_k")).select(key, "_range", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    upto = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("_own", F.sum(value).over(upto)).join(sums, [key, "_range"]).withColumn("_sum", F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def unique_slugs(rows: DataFrame, base: str = "slug_base", order: str = "arrival_idx", stored: str | None = None) -> DataFrame:
    """Adds `slug` to rows of an order of arrival: the stored one where there is one (they are reserved), else by number from the base."""
    if stored is None:
        return numbered_slugs(rows, base, order)
    kept = F.trim(T.filled(stored)) != ""
    new = numbered_slugs(rows.where(~kept), base, order, rows.where(kept).select(F.trim(F.col(stored)).alias("slug")).distinct())
    return new.unionByName(rows.where(kept).withColumn("slug", F.trim(F.col(stored))))
