"""Entities, their resolution, and the event-entity graph."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import money
from ..functions import text as T
from ..sources import scratch

BLOCK = 1000
TASK_PAIRS, MOST_TASKS, LANES = 1_000_000, 20_000, 8


def alias_join(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (name) joined to aliases (alias_key, entity) on the normalised name."""
    return names.withColumn("alias_key", T.entity_key("name")).join(aliases, "alias_key", "left")


def nearest_entity(names: DataFrame, entities: DataFrame, threshold: float = 0.72) -> DataFrame:
    """(name, entity, similarity): the entity of the highest token Jaccard at or above the threshold; ties by name.

    Token sets meet over a rarest-first prefix, so a word that every name has joins nothing.
    """

    def sets(df: DataFrame, c: str) -> DataFrame:
        toks = F.array_distinct(F.filter(F.split(T.entity_key(c), " "), lambda t: F.length(t) > 2))
        return df.select(c).distinct().withColumn("toks", toks).where(F.size("toks") > 0)

    left, right = sets(names, "name"), sets(entities, "entity")
    df = left.select(F.explode("toks").alias("t")).unionByName(right.select(F.explode("toks").alias("t"))).groupBy("t").agg(F.count(F.lit(1)).alias("df"))

    def prefix(x: DataFrame, c: str) -> DataFrame:
        w = Window.partitionBy(c).orderBy("df", "t")
        rows = x.select(c, "toks", F.explode("toks").alias("t")).join(df, "t").withColumn("at", F.row_number().over(w))
        return rows.where(F.col("at") <= F.size("toks") - F.ceil(F.lit(threshold) * F.size("toks")) + 1).select("t", c, "toks")

    a, b = prefix(left, "name"), prefix(right.withColumnRenamed("toks", "toks"), "entity").withColumnRenamed("toks", "other")
    pairs = a.join(b, "t").select("name", "entity", "toks", "other").distinct()
    similarity = F.size(F.array_intersect("toks", "other")) / F.size(F.array_union("toks", "other"))
    good = pairs.withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    best = good.groupBy("name").agg(F.min_by(F.struct("entity", "similarity"), F.struct(-F.col("similarity"), "entity")).alias("b"))
    return best.select("name", "b.entity", "b.similarity")


def edges(cases: DataFrame) -> DataFrame:
    """(event_id, entity, role): a subject and each named authority."""
    subject = cases.select(F.col("id").alias("event_id"), T.entity_key("company").alias("entity"), F.lit("subject").alias("role"))
    named = cases.select(F.col("id").alias("event_id"), F.explode(T.authorities("authority")).alias("n")).select("event_id", T.entity_key("n").alias("entity"), F.lit("authority").alias("role"))
    return subject.unionByName(named).where("entity <> ''").distinct()


def rollup(cases: DataFrame) -> DataFrame:
    """Of each subject: events, penalty, authorities, first and last year."""
    year = F.left("date", F.lit(4))
    return cases.groupBy(T.entity_key("company").alias("entity")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.round(F.sum("penalty_amount_inr"), 2).alias("total_inr"),
        F.array_join(F.array_sort(F.collect_set("authority")), "; ").alias("authorities"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
    )


def related_entities(links: DataFrame, most: int = 12, first_seen: DataFrame | None = None) -> DataFrame:
    """Entities that share an event, by how many, then as first seen if (entity, first_seen) is given, else by name; `most` of each. links: (event_id, entity).

    Tasks are as many as the pairs ask for, about TASK_PAIRS to each, whatever the session's number of shuffle partitions. An event of very many entities is
    dealt out in blocks of BLOCK: every two blocks meet in a task of their own. Pairs are counted in the task that made them, then added up; an entity's related ones
    are ranked in LANES lanes first.
    """
    x = links.select("event_id", "entity").where("event_id IS NOT NULL AND entity IS NOT NULL")
    sizes, k = Observation(), F.col("k")
    counts = x.groupBy("event_id").agg(F.count(F.lit(1)).alias("k")).observe(sizes, F.sum(k.cast("double") * (k - 1)).alias("pairs"), F.count_if(k > BLOCK).alias("big"))
    big = scratch.stored(counts.where(k > BLOCK).select("event_id", F.ceil(k / BLOCK).cast("int").alias("blocks")))
    tasks = min(MOST_TASKS, max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((sizes.get["pairs"] or 0) / TASK_PAIRS)))
    if sizes.get["big"]:
        sized = x.join(big, "event_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = sized.select("event_id", "entity", F.pmod(F.xxhash64("entity"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    else:
        dealt = x.withColumns({c: F.lit(0) for c in ("block", "lo", "hi")})
    cell = F.pmod(F.xxhash64("event_id", "lo", "hi"), F.lit(tasks)).cast("int")
    met = dealt.withColumn("cell", cell).repartitionById(tasks, F.col("cell")).groupBy("cell", "event_id", "lo", "hi").agg(F.collect_set(F.struct("block", "entity")).alias("of"))
    pairs = met.select("cell", "lo", "hi", "of", F.explode("of").alias("a")).select("cell", "lo", "hi", "a", F.explode("of").alias("b")).where("a.block = lo AND b.block = hi AND (lo < hi OR a.entity < b.entity)")
    shared = pairs.groupBy("cell", F.col("a.entity").alias("a"), F.col("b.entity").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ways = [F.struct(F.col(p).alias("entity"), F.col(q).alias("related")) for p, q in ("ab", "ba")]
    both = shared.select(F.explode(F.array(*ways)).alias("p"), "n").select("p.entity", "p.related", F.pmod(F.xxhash64("p.related"), F.lit(LANES)).alias("lane"), "n")
    both = both.repartition(tasks, "entity", "lane").groupBy("entity", "lane", "related").agg(F.sum("n").alias("shared"))
    if first_seen is not None:
        seen = first_seen.select(F.col("entity").alias("related"), "first_seen")
        both = both.repartition(tasks, "related").join(seen, "related").repartition(tasks, "entity", "lane")
    order = [F.desc("shared"), *(["first_seen"] if first_seen is not None else []), "related"]
    few = both.withColumn("rank", F.row_number().over(Window.partitionBy("entity", "lane").orderBy(*order))).where(F.col("rank") <= most)
    best = few.repartition(tasks, "entity").withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(*order)))
    return best.where(F.col("rank") <= most).select("entity", "related", "shared", "rank")


def contradictions(claims: DataFrame) -> DataFrame:
    """(event_id, field, variants): fields for which claims differ after normalising. claims: (event_id, field, value)."""
    return (
        claims.withColumn("norm", money.core("value"))
        .groupBy("event_id", "field")
        .agg(F.count_distinct("norm").alias("n"), F.array_join(F.array_sort(F.collect_set("value")), " | ").alias("variants"))
        .where("n > 1")
        .select("event_id", "field", F.col("n").alias("n_values"), "variants")
    )


def pageable(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("entity_type").isin(L.PAGEABLE_TYPES) & (F.col("n_events") > 0))


def companies(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("entity_type") == "company")


def regulators(entities: DataFrame) -> DataFrame:
    """Regulators and courts."""
    return entities.where(F.col("entity_type").isin("regulator", "court"))
