"""Line dedup by deletion neighbourhoods, in DataFrame functions only.

A line is its words: runs of other than blanks, in lower case. Lines of equal words are repeats, whatever their length; lines of NEAR_WORDS or more that one inserted,
deleted or replaced word tells apart (word edit distance 1) are near copies. Of repeats and near copies the earliest line stays, in order of doc_id, then place.

1. Equal lines are grouped by two 64-bit hashes; each group's earliest occurrence stands for it.
2. Lines of one edit agree in the words before the middle or in those after it. Lines that share neither half with another line can have no near
   copy and go no further; this loses nothing.
3. Of the others all variants with one word deleted, and the line itself, are emitted as hashed keys. Lines of one key and one deleted
   place are each other's near copies, a line and the variants equal to it likewise; so the key's earliest line is all that must be known, and no pairs
   within a key are made.
4. Each line's earliest candidate is verified on the words, and the line goes if the distance holds.

A line is dropped when an earlier line is near it, whether that one itself is kept or not. Every line that has a word is judged. In lines
below NEAR_WORDS one edit is no sign of a copy: see the README for the share of lines with such a neighbour by length.

Defined results: a null text stays null and has no lines; a text of no line breaks is one line; rows of one doc_id are in order of
their text hash, null ids come first; equal rows (same id and text) count as one and lose the same lines; no rows give no rows;
other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import scratch
from . import common

LEAST_WORDS = 1
NEAR_WORDS = 4
_BLANK = "[ \t\x0b\x0c\r]+"


def line_words(line: str) -> Column:
    rare = [F.contains(F.col(line), F.lit(b)) for b in "\t\x0b\x0c\r"]
    # a split at one plain sign needs no pattern, which most lines are spared
    at_blanks = F.when(rare[0] | rare[1] | rare[2] | rare[3], F.split(F.lower(line), _BLANK)).otherwise(F.split(F.lower(line), " "))
    return F.array_remove(at_blanks, "")


def _half_keys(w: str) -> Column:
    """Keys of the halves: as the longer or equal line of a pair, and as the shorter one."""
    n = F.size(w)
    keys = []
    for size in (n, n - 1):  # the size of the shorter line
        p = F.floor(size / 2).cast("int")
        rest = size - p
        keys += [F.xxhash64(F.lit("p"), size, F.slice(w, F.lit(1), p)), F.xxhash64(F.lit("s"), size, F.slice(w, n - rest + 1, rest))]
    return F.when(n >= NEAR_WORDS, F.array(*keys))


def exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, line) of each line that may have enough words to be judged."""
    # hashed in a projection of its own: beside the generator Spark would hash the whole text again for each of its lines
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    lines = texts.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.length("line") >= 2 * LEAST_WORDS - 1)


def only_of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines whose place may be wanted: by bitmaps over hashed places, of fixed size whatever the input."""
    place = F.xxhash64("text_hash", "line_no").alias("_place")
    return common.maybe_in(lines.select("*", place), wanted.select(place), "_place").drop("_place")


def one_edit(x: Column, y: Column) -> Column:
    """Whether two word lists differ by one word inserted, deleted or replaced."""
    longer, shorter = F.when(F.size(x) >= F.size(y), x).otherwise(y), F.when(F.size(x) >= F.size(y), y).otherwise(x)
    n = F.size(longer)
    same = F.zip_with(x, y, lambda a, b: a.eqNullSafe(b))
    replaced = F.size(F.filter(same, lambda s: ~s)) <= 1
    first = F.array_position(same, F.lit(False)).cast("int")  # the first place at which they differ
    inserted = F.slice(longer, first + 1, n) == F.slice(shorter, F.greatest(F.lit(1), first), n)
    return F.when(F.size(x) == F.size(y), replaced).when(n - F.size(shorter) == 1, inserted).otherwise(False)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, gone): the ascending places of each document's dropped lines."""
    line_id = ["h", "h2"]
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.col("text_hash").alias("t"), F.col("line_no").alias("l"))
    rows = exploded(docs).select("doc_id", "text_hash", "line_no", line_words("line").alias("w"))
    rows = rows.select("doc_id", "text_hash", "line_no", F.size("w").alias("n"), F.xxhash64("w").alias("h"), F.xxhash64("w", F.lit(1)).alias("h2"), _half_keys("w").alias("keys"))
    # filtered when read again: before, the filter would split every line once more
    stored = scratch.stored(rows)
    rows = stored.where(F.col("n") >= LEAST_WORDS)
    # equal rows of documents count once
    least = F.min(F.struct("at.*", "keys")).alias("f")
    groups = rows.withColumn("at", order).groupBy(*line_id).agg(least, F.max("at").alias("last"), F.count(F.lit(1)).alias("k"))
    groups = groups.select(*line_id, F.struct("f.d", "f.t", "f.l").alias("first"), "last", "k", F.col("f.keys").alias("keys"))
    groups = scratch.stored(groups.withColumn("again", F.col("first") != F.col("last")).drop("last"))
    halves = groups.where("keys IS NOT NULL").select(*line_id, F.explode("keys").alias("key"))
    shared = halves.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi").select("key", "k")
    shared = scratch.stored(shared)
    near = common.join_hot(halves, shared, "key").select(*line_id).distinct()
    near = scratch.stored(near.join(groups.select(*line_id, "first"), line_id))

    places = near.select(F.col("first.t").alias("text_hash"), F.col("first.l").alias("line_no"))
    words = only_of(exploded(docs), places).select(order.alias("at"), line_words("line").alias("w")).withColumns({"h": F.xxhash64("w"), "h2": F.xxhash64("w", F.lit(1))})
    lines = words.join(near.select(*line_id, F.col("first").alias("at")), [*line_id, "at"]).groupBy(*line_id).agg(F.first("at").alias("at"), F.first("w").alias("w"))
    lines = scratch.stored(lines)
    scratch.discard(near, shared)
    # a hash of words by place, joined by exclusive or: without the word at a place, those after it count one place less
    each = lines.select(*line_id, "at", F.posexplode("w").alias("p", "word")).withColumns({"here": F.xxhash64("word", "p"), "moved": F.xxhash64("word", F.col("p") - 1)})
    line = Window.partitionBy(*line_id)
    upto = line.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    xor = lambda c, w, name: F.expr(f"bit_xor({c})").over(w).alias(name)
    each = each.select("at", "p", "here", xor("here", upto, "front"), xor("moved", upto, "gone"), xor("moved", line, "all"), xor("here", line, "whole"))
    key = F.col("front").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("all")).bitwiseXOR(F.col("gone"))
    entry = lambda place, k: F.struct(place.alias("place"), k.alias("key"))
    own = F.array(entry(F.col("p") + 1, key))
    both = F.when(F.col("p") == 0, F.array(entry(F.col("p") + 1, key), entry(F.lit(0), F.col("whole")))).otherwise(own)
    variants = scratch.stored(each.select("at", F.explode(both).alias("v")).select("at", F.xxhash64("v.key", "v.place").alias("twin"), "v.place", "v.key"))
    # a key of one variant tells nothing: counted by the keys alone, so that few variants are dealt out with their places
    met = scratch.stored(variants.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"))
    twins = common.maybe_in(variants, met, "key").groupBy("key", "place").agg(F.min("at").alias("same"), F.count(F.lit(1)).alias("k"))
    of_key = Window.partitionBy("key")  # as many rows as the key has places
    keys = {"any": F.min("same").over(of_key), "whole": F.min(F.when(F.col("place") == 0, F.col("same"))).over(of_key)}
    before = F.when(F.col("place") == 0, F.col("any")).otherwise(F.least("same", "whole"))
    # a line's earliest candidates: those equal to the line itself go at once, and with them keys of one line
    earliest = scratch.stored(twins.withColumns(keys).select(F.xxhash64("key", "place").alias("twin"), before.alias("before"), "k").where((F.col("k") > 1) | (F.col("before") != F.col("same"))))
    again = common.maybe_in(variants.select("twin", "at"), earliest, "twin")
    candidates = common.join_hot(again, earliest, "twin").where(F.col("before") < F.col("at")).select("at", "before").distinct()
    candidates = scratch.stored(candidates)
    scratch.discard(variants, met, earliest)
    other = lines.select(F.col("at").alias("before"), F.col("w").alias("y"), F.lit(1).alias("one"))
    mine = lines.select(*line_id, "at", F.col("w").alias("x"))
    pairs = common.join_hot(candidates, other.drop("one"), "before").join(mine, "at")
    flagged = scratch.stored(pairs.where(one_edit(F.col("x"), F.col("y"))).select(*line_id, F.lit(True).alias("near")).distinct())

    judged = groups.select(*line_id, "first", "again", "k").join(flagged, line_id, "left").where("again OR near")
    judged = scratch.stored(judged.select(F.struct(*line_id).alias("line"), "first", F.coalesce("near", F.lit(False)).alias("near"), "k"))
    gone = common.join_hot(rows.select("doc_id", "text_hash", "line_no", F.struct(*line_id).alias("line")), judged, "line").where(F.col("near") | (order != F.col("first")))
    gone = scratch.stored(gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("gone")))
    scratch.discard(stored, groups, lines, candidates, flagged, judged)
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with their dropped lines cut out of `text`; adds _n_lines and _n_dropped (in place of columns of those names)."""
    names = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    gone = dropped_lines(docs.select("doc_id", "text")).select(F.xxhash64("doc_id", "text_hash").alias("key"), "gone")
    rows = docs.select(F.struct(*names).alias("doc"), F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"))
    # only texts that may lose lines are dealt out to meet their places
    rows = common.maybe_in(rows, gone, "key").join(gone, "key", "left").unionByName(common.not_in(rows, gone, "key").withColumn("gone", F.lit(None).cast("array<int>")))
    text, lines = F.col("doc.text"), F.col("lines")
    # not deterministic, so that Spark writes it into no filter or lambda: once, not for each line
    rows = rows.withColumn("lines", F.split(text, "\n", F.when(F.monotonically_increasing_id() < 0, 0).otherwise(-1)))
    rows = rows.withColumn("left", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")))
    kept = F.array_join(F.transform("left", lambda i: F.get(lines, i)), "\n")
    return rows.select(
        *[F.when(F.col("gone").isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in names],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("_n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("_n_dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


def line_dedup_stage(docs: DataFrame) -> DataFrame:
    """The documents with fewer lines. One that loses lines and keeps no letter or digit goes; n_chars follows the text."""
    out = dedup_lines(docs)
    out = out.where((F.col("_n_dropped") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


ORACLE_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM documents),
t AS (SELECT doc_id, no, line, list_filter(regexp_split_to_array(lower(line), '[ \t\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM l),
j AS (SELECT doc_id, no, w, array_to_string(w, ' ') AS k FROM t WHERE len(w) >= {LEAST_WORDS}),
u AS (SELECT k, min((doc_id, no)) AS pos, first(w) AS w FROM j GROUP BY k),
big AS (SELECT * FROM u WHERE len(w) >= {NEAR_WORDS}),
p AS (SELECT k, pos, len(w) AS n, w, unnest(range(1, len(w) + 1)) AS i FROM big),
v AS (SELECT k, pos, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ') AS key FROM p),
near AS (SELECT DISTINCT a.k FROM v a JOIN v b ON a.key = b.key AND a.i = b.i AND a.n = b.n WHERE b.pos < a.pos
  UNION SELECT DISTINCT a.k FROM v a JOIN big b ON a.key = b.k WHERE b.pos < a.pos
  UNION SELECT DISTINCT a.k FROM big a JOIN v b ON a.k = b.key WHERE b.pos < a.pos),
g AS (SELECT j.doc_id, j.no FROM j JOIN u USING (k) WHERE (j.doc_id, j.no) <> u.pos OR k IN (SELECT k FROM near)),
s AS (SELECT l.doc_id, count(*) AS n_lines, count(g.no) AS n_dropped, string_agg(line, chr(10) ORDER BY l.no) FILTER (WHERE g.no IS NULL) AS text
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text
FROM documents d LEFT JOIN s USING (doc_id)
"""
