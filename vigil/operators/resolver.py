"""Entity resolution with feedback: each answer becomes an alias, and each new entity can be found by the names after it.

In order of first sight a name is resolved by
  1. its normal form, if a curated alias or an earlier answer has it,
  2. else the known entity of the highest token Jaccard, at or above a threshold (the entity made first, of equal ones),
  3. else it makes an entity of its own.

Whether a name makes an entity depends on which earlier names did. It is settled for all names at once: candidate pairs come from one prefix-filtered
similarity join, and in each round every name is decided whose earlier candidates all are. The earliest undecided name always can be, so the
rounds end in the sequential answer; chains of near names are short, so they are few.

Names of one token set are one node of that join (only the first of them can make an entity), so no pairs are made of variants in spelling or suffix.
Names that are null or have no normal form resolve to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..sources import scratch
from .clustering import numbered_slugs

THRESHOLD = 0.72


def token_set(key: Column | str) -> Column:
    """The distinct tokens of three signs or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(key, " "), lambda t: F.length(t) > 2)))


def alias_seeds(spark: SparkSession, seeds: dict[str, list[str]] | None = None) -> DataFrame:
    """(norm, key, canonical) of the curated aliases; a variant that is listed twice is the later one's."""
    seeds = L.ALIAS_SEEDS if seeds is None else seeds
    rows = [(k, c, v) for k, (c, vs) in enumerate(seeds.items()) for v in [c, *vs]]
    named = spark.createDataFrame(rows, "at int, canonical string, variant string").select("at", "canonical", T.entity_key("variant").alias("norm"), T.entity_key("canonical").alias("key"))
    return named.groupBy("norm").agg(F.max_by(F.struct("key", "canonical"), "at").alias("s")).select("norm", "s.key", "s.canonical")


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): token sets of Jaccard at or above the threshold. left, right: (toks), distinct; sets meet over a rarest-first prefix."""
    both = left.select("toks").unionByName(right.select("toks")).distinct()
    df = both.select(F.explode("toks").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))

    def prefix(x: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("toks").orderBy("df", "t")
        rows = x.select("toks", F.explode("toks").alias("t")).join(df, "t").withColumn("at", F.row_number().over(w))
        return rows.where(F.col("at") <= F.size("toks") - F.ceil(F.lit(threshold) * F.size("toks") - 1e-9) + 1).select("t", F.col("toks").alias(name))

    pairs = prefix(left, "a").join(prefix(right, "b"), "t").where((F.size("a") >= threshold * F.size("b") - 1e-9) & (F.size("b") >= threshold * F.size("a") - 1e-9)).select("a", "b").distinct()
    return pairs.withColumn("similarity", F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).where(F.col("similarity") >= threshold)


def resolve(names: DataFrame, name: str = "name", order: str = "order", threshold: float = THRESHOLD, seeds: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved: norm, key), (entities: key, name, entity_type, slug, first_seen) and (aliases: key, alias). names: raw names and the order they came in, which is distinct."""
    spark = names.sparkSession
    raw = names.select(F.trim(F.col(name)).alias("raw"), F.col(order).alias("pos"), T.entity_key(name).alias("norm")).where("norm <> ''")
    norms = raw.groupBy("norm").agg(F.min("pos").alias("pos"), F.min_by("raw", "pos").alias("raw"))
    norms = scratch.stored(norms.join(F.broadcast(alias_seeds(spark, seeds)), "norm", "left"))  # the curated list has a fixed size

    curated = norms.where("key IS NOT NULL").groupBy("key", "canonical").agg(F.min("pos").alias("pos")).select("key", F.col("canonical").alias("name"), "pos", token_set("key").alias("toks"))
    free = norms.where("key IS NULL").select("norm", "pos", "raw", token_set("norm").alias("toks"))
    nodes = scratch.stored(free.where(F.size("toks") > 0).groupBy("toks").agg(F.min("pos").alias("pos"), F.min_by("norm", "pos").alias("norm")))
    # pairs of different sets, and curated entities with any set
    fixed = curated.where(F.size("toks") > 0).select("toks", "pos", F.col("key").alias("entity"), F.lit(True).alias("curated"))
    known = scratch.stored(fixed.unionByName(nodes.select("toks", "pos", F.col("norm").alias("entity"), F.lit(False).alias("curated"))))
    close = scratch.stored(similar_sets(nodes.select("toks"), known.select("toks").distinct(), threshold))
    links = close.join(known.select(F.col("toks").alias("b"), F.col("pos").alias("other_pos"), "entity", "curated"), "b")
    links = scratch.stored(links.select("a", "b", "similarity", "other_pos", "entity", "curated").where((F.col("a") != F.col("b")) | F.col("curated")))

    # leaders: the nodes that make an entity of their own
    earlier = links.join(nodes.select(F.col("toks").alias("a"), F.col("pos").alias("own_pos")), "a").where(F.col("other_pos") < F.col("own_pos")).select("a", "b", "curated")
    earlier = scratch.stored(earlier)
    status = scratch.stored(nodes.select("toks", F.lit(None).cast("boolean").alias("leads")))
    while True:
        seen = earlier.join(status.select(F.col("toks").alias("b"), "leads"), "b", "left").withColumn("leads", F.col("curated") | F.col("leads"))
        # one earlier leader settles it; else all must be settled
        seen = seen.groupBy(F.col("a").alias("toks")).agg(F.max(F.coalesce("leads", F.lit(False))).alias("near"), F.max(F.col("leads").isNull()).alias("open"))
        now = status.select("toks").join(seen, "toks", "left")
        now = scratch.stored(now.select("toks", F.when(F.coalesce("near", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True).alias("leads")))
        scratch.discard(status)
        status = now
        if not status.where("leads IS NULL").limit(1).count():
            break

    leaders = scratch.stored(nodes.join(status.where("leads"), "toks").select("toks", "pos", F.col("norm").alias("entity"), F.lit(False).alias("curated")).unionByName(fixed))
    # of every name: its own set's leader, or the nearest earlier one
    near = close.join(leaders.select(F.col("toks").alias("b"), "pos", "entity"), "b").select(F.col("a").alias("toks"), "similarity", F.col("pos").alias("made"), "entity")
    found = free.where(F.size("toks") > 0).join(near, "toks").where(F.col("made") <= F.col("pos"))
    found = found.groupBy("norm").agg(F.min_by("entity", F.struct(-F.col("similarity"), F.col("made"))).alias("key"))
    resolved = norms.select("norm", "pos", "raw", F.col("key").alias("seed")).join(found, "norm", "left").select("norm", "pos", "raw", F.coalesce("seed", "key", "norm").alias("key"))
    resolved = scratch.stored(resolved)

    own = resolved.where("norm = key").select("key", F.col("raw").alias("own_name"))
    made = resolved.groupBy("key").agg(F.min("pos").alias("first_seen")).join(own, "key", "left").join(F.broadcast(curated.select("key", "name")), "key", "left")
    made = made.select("key", F.coalesce("name", "own_name").alias("name"), "first_seen")
    entities = numbered_slugs(made.withColumn("base", T.slug("name", 5)), "base", "first_seen").select("key", "name", T.entity_type("name").alias("entity_type"), "slug", "first_seen")
    aliases = raw.join(resolved.select("norm", "key"), "norm").where("norm <> key").select("key", F.col("raw").alias("alias")).distinct()
    scratch.discard(nodes, known, close, links, earlier, status)
    return resolved.select("norm", "key"), entities, aliases


def related(links: DataFrame, entities: DataFrame, most: int = 12) -> DataFrame:
    """(entity, related, shared, rank): pageable entities that share events, by how many, then as first seen. links: (event_id, entity).

    Only entities that have a page take part, and a shared event counts once however many roles it gives.
    """
    from . import graph

    paged = entities.where(F.col("entity_type").isin(L.PAGEABLE_TYPES)).select(F.col("key").alias("entity"), "first_seen")
    return graph.related_entities(links.join(paged.select("entity"), "entity", "left_semi"), most, paged)
