"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is SPAN consecutive words of a benchmark item; a shorter item is one window. Hashes of KGRAM words are taken of documents and
items; of every KEEP consecutive ones the least is kept with its place, KGRAM + KEEP - 1 = SPAN, so that any shared window shares a kept hash,
at the same place in it. Documents that share one with the benchmark (or hold a short item's hash) are read again, one text of each, and
each hit is extended: the windows around its place are compared with the items'. The words that
occurring windows cover are counted as a union of spans.

Letters are folded from A to Z alone, for the fingerprints as for the windows: lower case beyond them may depend on what follows (capital sigma),
and then equal words would differ. Texts and windows are equal if two 64-bit hashes of each are.

Defined results: null has no words; documents and items without words hit nothing; equal rows have equal results, rows of one id
with different texts their own; a null item_id counts as the id `null`; no documents give no rows, no items no hits; other columns
are ignored. The benchmark's tables are broadcast only when their counted size is within BROADCAST_ROWS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SPAN = 13
KGRAM = 7
KEEP = SPAN - KGRAM + 1
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(folded: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), _BREAK), "")


def fold_ascii(text: Column | str) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def hashed(df: DataFrame, text: str) -> DataFrame:
    """Adds `w` and `v`: two hashes of each word of the text. Elements are read by place: slices within lambdas would copy the array each time."""
    df = df.withColumn("_w", words(fold_ascii(text)))
    return df.withColumns({"w": F.transform("_w", lambda x: F.xxhash64(x)), "v": F.transform("_w", lambda x: F.xxhash64(x, F.lit(1)))}).drop("_w")


def gram(w: str, i: Column, k: int) -> Column:
    """Hash of the k words from place i (from 0)."""
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def places(w: str, k: int) -> Column:
    """Places at which k words begin."""
    return F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))


def grams(w: str, k: int) -> Column:
    """Hashes of each k consecutive words; none of fewer."""
    return F.transform(places(w, k), lambda i: gram(w, i, k))


def winnowed(df: DataFrame, w: str, out: str) -> DataFrame:
    """Adds `out`, array<struct<g, pos>>: the least of every KEEP hashes with its place, once for neighbours that share it.

    Such columns are to be exploded by explode_outer: of explode Spark infers a filter on the array's size, into which it would write out all of this, to be
    worked out anew for each element.
    """
    rows = df.withColumn("_g", grams(w, KGRAM))
    rows = rows.withColumn("_m", F.transform(places("_g", KEEP), lambda i: F.least(*[F.get("_g", i + j) for j in range(KEEP)])))

    def least(m: Column, i: Column) -> Column:
        at = i
        for j in range(KEEP):  # the rightmost of equal ones
            at = F.when(F.get("_g", i + j) == m, i + j).otherwise(at)
        return F.struct(m.alias("g"), at.cast("int").alias("pos"))

    rows = rows.withColumn("_k", F.transform("_m", least))
    fresh = F.filter("_k", lambda x, i: (i == 0) | (F.get("_k", i - 1)["pos"] != x["pos"]))
    return rows.withColumn(out, fresh).drop("_g", "_m", "_k")


def sized(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is small by count; joined by shuffles else."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def text_key() -> Column:
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))


def _windows(starts: Column, n: int) -> Column:
    """array<struct<len, start, g, g2>> of the windows of n words at the places."""
    return F.transform(starts, lambda i: F.struct(F.lit(n).alias("len"), i.alias("start"), gram("w", i, n).alias("g"), gram("v", i, n).alias("g2")))


def _whole(n: int) -> Column:
    """Marks of all n words' hashes, at no place."""
    return F.transform(F.array_distinct(grams("w", n)), lambda g: F.struct(F.lit(n).alias("len"), g.alias("g"), F.lit(-1).alias("pos")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, n_hit, items) of each document; key: the text's; items: sorted ids, null if none."""
    items = hashed(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text"), "text").drop("text")
    items = common.materialise(items.where(F.size("w") > 0))
    size = F.size("w")
    made = F.when(size >= SPAN, _windows(places("w", SPAN), SPAN))
    for n in range(1, SPAN):
        made = made.when(size == n, _windows(F.array(F.lit(0)), n))
    windows = common.materialise(items.select("item", F.explode_outer(made).alias("x")).select("item", "x.len", "x.g", "x.g2").distinct())
    short = sorted(r[0] for r in windows.where(F.col("len") < SPAN).select("len").distinct().collect())
    marks = winnowed(items.where(size >= SPAN), "w", "k").select(F.lit(0).alias("len"), F.explode_outer("k").alias("k")).select("len", "k.g")
    brief = windows.where(F.col("len") < SPAN).select("len", "g")
    marks = sized(common.materialise(marks.unionByName(brief).distinct()))

    rows = winnowed(hashed(docs.select("doc_id", text_key().alias("key"), "text"), "text"), "w", "kept")
    found = [F.transform("kept", lambda x: F.struct(F.lit(0).alias("len"), x["g"].alias("g"), x["pos"].alias("pos"))), *[_whole(n) for n in short]]
    rows = common.materialise(rows.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.concat(*found).alias("marks")))
    hit = rows.select("key", F.explode("marks").alias("m")).select("key", "m.*").join(marks, ["len", "g"], "left_semi")
    # of one text's copies the places are the same: a set no larger than the text
    again = common.materialise(hit.groupBy("key").agg(F.collect_set("pos").alias("at")))

    texts = docs.select(text_key().alias("key"), "text").join(sized(again.select("key")), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.first("text").alias("text")).join(again, "key")
    placed = hashed(texts, "text")
    # a kept hash at a place lies in the windows that begin up to KEEP - 1 places before it
    around = F.flatten(F.transform(F.filter("at", lambda p: p >= 0), lambda p: F.sequence(F.greatest(F.lit(0), p - (KEEP - 1)), p)))
    placed = placed.withColumn("starts", F.array_distinct(F.filter(around, lambda i: i <= F.size("w") - SPAN)))
    made = F.concat(_windows(F.col("starts"), SPAN), *[_windows(places("w", n), n) for n in short])
    spans = placed.select("key", F.explode_outer(made).alias("x")).select("key", "x.*")
    hits = common.materialise(spans.join(sized(windows.select("len", "g", "g2").distinct()), ["len", "g", "g2"], "left_semi"))

    end = F.col("start") + F.col("len")
    before = F.max(end).over(Window.partitionBy("key").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), end - F.greatest(F.coalesce(before, F.lit(0)), "start"))
    covered = hits.withColumn("fresh", fresh).groupBy("key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = hits.select("key", "len", "g", "g2").distinct().join(sized(windows), ["len", "g", "g2"]).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = common.materialise(covered.join(named, "key"))
    common.discard(again, hits, items)
    return common.join_hot(rows.select("doc_id", "key", "n_words"), result, "key", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def decontamination_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Keeps the documents that are not contaminated, as they were."""
    bad = common.materialise(contamination(docs, benchmark).where(contaminated()).select("key").distinct())
    rows = docs.select(F.struct(*docs.columns).alias("doc"), text_key().alias("key"))
    return rows.join(sized(bad), "key", "left_anti").select("doc.*")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), {SPAN}) AS k, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM di),
hit AS (SELECT doc_id, k, i, g FROM dw WHERE (k, g) IN (SELECT k, g FROM bw)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS l FROM hit JOIN bw USING (k, g) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
