"""Spelling variants by merging in the errata trie, in DataFrame functions only.

The trie of all words is never built in one place: a node is a prefix, and its children are counted by an aggregation over (prefix, next character).
The child with the most words below it is the node's heavy one; every other child, and a word that ends at the node, is light. A
word passes at most log2(words) light edges.

Two words of one edit part at one node, and at least one of them leaves it by a light edge. So at each node the light subtrees alone are merged
into the rest, with the character of the light edge
  * replaced by the heavy one (the other word runs along the heavy path),
  * replaced by any (both are light: equal remainders below one node coincide),
  * skipped (the other word has one character less), or
  * kept behind an inserted heavy one (the other word has one character more),
and terminals that coincide are the pairs. Of a run of equal characters only the last is skipped, so each pair is found once.

Nodes are known by 64-bit hashes of their prefixes. That two prefixes might share one loses nothing: they then share a heavy character, and the argument above needs
only that all words of a node agree on it. Terminals are compared as strings.

A node is passed by as many words as lie below it, the root by all: nodes of fewer than SHORT characters are joined by broadcast (the alphabet has 90
characters, so there are at most 8,191), deeper ones by common.join_hot, which splits those of very many words. Words with equal
remainders below a node are at most as many as the alphabet; their pairs are not written out, the best two and the count stand for them.

Forms rise in frequency at least twofold at each step, so chains are short; roots are found by doubling pointers until nothing changes.

Defined results: null texts have no words; a null doc_id counts as the empty text in the hash; rows of one id, and repeated rows, count each; no words
of LEAST occurrences give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .decontamination import _LOWER, _UPPER

LENGTH = 5
LEAST = 3
SHORT = 3
_BREAK = "[^a-zÀ-ÿ]+"
_ONE_OFF = 97


def counted(docs: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(word, n) of the words of enough characters and occurrences."""
    folded = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    # explode_outer: of explode Spark would infer a filter that splits the text once more
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode_outer(F.split(folded, _BREAK)).alias("r"))
    runs = runs.where(F.length("r") >= length)
    # crc32 gives the unsigned value
    hashed = runs.select("r", F.crc32(F.concat("d", F.lit(":"), "r").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("r")).cast("int")
    cut = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))
    made = hashed.select(F.when(F.pmod("h", F.lit(_ONE_OFF)) == 0, cut).otherwise(F.col("r")).alias("word"))
    return made.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _node(word: str, depth: Column) -> Column:
    return F.xxhash64(F.substring(word, F.lit(1), depth), depth)


def light_edges(words: DataFrame) -> DataFrame:
    """(word, n, depth, heavy): each word's light edges; depth: characters before the edge, the word's own length if it ends at the node."""
    steps = words.select("word", "n", F.explode_outer(F.sequence(F.lit(0), F.length("word"))).alias("depth"))
    steps = steps.withColumns({"node": _node("word", F.col("depth")), "edge": F.substring("word", F.col("depth") + 1, F.lit(1))})
    edges = steps.groupBy("node", "edge", (F.col("depth") < SHORT).alias("short")).agg(F.count(F.lit(1)).alias("k"))
    # of the children; the end of a word (an empty edge) is always light
    heavy = F.min(F.when(F.col("edge") != "", F.struct((-F.col("k")).alias("k"), F.col("edge").alias("heavy"))))
    nodes = edges.groupBy("node", "short").agg(heavy.alias("h"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("edges"))
    # a node with one edge has no light one
    nodes = common.materialise(nodes.where((F.col("edges") > 1) & F.col("h").isNotNull()).select("node", "short", "k", F.col("h.heavy").alias("heavy")))
    top = F.broadcast(nodes.where("short").select("node", "heavy"))
    above = steps.where(F.col("depth") < SHORT).join(top, "node")
    below = common.join_hot(steps.where(F.col("depth") >= SHORT), nodes.where("NOT short").select("node", "heavy", "k"), "node")
    found = above.unionByName(below).where(F.col("edge") != F.col("heavy"))
    return found.select("word", "n", "depth", "heavy")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): for each word with near ones their count, and the one of the largest n (the smallest in code-point order of equal ones)."""
    light = common.materialise(light_edges(words))
    before, rest = F.substring("word", F.lit(1), F.col("depth")), F.substring("word", F.col("depth") + 2, F.length("word"))
    own = F.substring("word", F.col("depth") + 1, F.lit(1))
    ends = own == ""
    tries = F.array_compact(
        F.array(
            F.when(~ends, F.concat(before, "heavy", rest)),  # replaced by the heavy character
            F.when(~ends & (own != F.substring("word", F.col("depth") + 2, F.lit(1))), F.concat(before, rest)),  # skipped
            F.concat(before, "heavy", own, rest),  # behind the heavy character
        )
    )
    sought = light.select("word", "n", F.explode_outer(tries).alias("other")).where(F.length("other") >= 1)
    pairs = sought.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    one = pairs.select("word", F.lit(1).alias("c"), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w")).alias("best"))
    two = pairs.select(F.col("other").alias("word"), F.lit(1).alias("c"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("w")).alias("best"))

    # both light: equal remainders below one node, at most as many as the alphabet has characters
    twins = light.where(~ends).select("word", "n", F.concat(before, F.lit("*"), rest).alias("terminal"))
    group = Window.partitionBy("terminal")
    order = group.orderBy(F.desc("n"), "word")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct((-F.col("n")).alias("n"), F.col("word").alias("w"))
    first, second = F.first(entry).over(whole), F.nth_value(entry, 2).over(whole)
    merged = twins.select("word", (F.count(F.lit(1)).over(whole) - 1).cast("int").alias("c"), first.alias("_1"), second.alias("_2")).where(F.col("c") > 0)
    three = merged.select("word", "c", F.when(F.col("_1.w") == F.col("word"), F.col("_2")).otherwise(F.col("_1")).alias("best"))
    found = one.unionByName(two).unionByName(three).groupBy("word").agg(F.sum("c").cast("long").alias("n_near"), F.min("best").alias("b"))
    return found.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: (word, form). Returns (word, root); a chain's pointers are doubled until none moves. Only words whose pointer can move are joined again."""
    open_ = common.materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        step = open_.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = common.materialise(open_.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        open_ = moved.select("word", "root")


def variant_groups(docs: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    words = common.materialise(counted(docs, length, least))
    near = common.materialise(near_words(words))
    taken = F.col("best_n") >= 2 * F.col("n")
    both = words.join(near, "word", "left").select(
        "word",
        F.when(taken, F.col("best")).alias("form"),
        F.col("n").cast("long").alias("n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best_n")).cast("long").alias("form_n"),
    )
    both = common.materialise(both)
    found = roots(both.where("form IS NOT NULL"))
    return both.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(common.table(spark, sf_dir, "documents"))


_CODE = "unicode(x)"
ORACLE_SQL = rf"""
WITH RECURSIVE t AS (SELECT list(list_reduce([CAST(i AS BIGINT)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) AS v(i)),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS r FROM documents),
b AS (SELECT r, flatten([CASE WHEN {_CODE} < 128 THEN [{_CODE}] ELSE [192 + {_CODE} // 64, 128 + {_CODE} % 64] END FOR x IN string_split(d || ':' || r, '')]) AS bytes FROM r WHERE length(r) >= {LENGTH}),
h AS (SELECT r, xor(list_reduce([4294967295] || [CAST(x AS BIGINT) FOR x IN bytes], lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
m AS (SELECT CASE WHEN h % {_ONE_OFF} = 0 THEN left(r, CAST(h % length(r) AS INT)) || substring(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word FROM h),
w AS (SELECT word, count(*) AS n FROM m WHERE length(word) >= {LENGTH} GROUP BY word HAVING count(*) >= {LEAST}),
k AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS key FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
p AS (SELECT a.word, o.word AS other, o.n AS other_n FROM k a JOIN k o ON a.i = o.i AND a.key = o.key AND a.word <> o.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.key = w.word UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.key = w.word),
f AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, first(other_n ORDER BY other_n DESC, other) AS best_n FROM p GROUP BY word),
o AS (SELECT word, CASE WHEN best_n >= 2 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM w LEFT JOIN f USING (word)),
c AS (SELECT word, word AS at, form AS nxt FROM o UNION ALL SELECT c.word, c.nxt, o.form FROM c JOIN o ON o.word = c.nxt)
SELECT o.word, o.form, c.at AS root, CAST(o.n AS BIGINT) AS n, CAST(o.n_near AS BIGINT) AS n_near, CAST(o.form_n AS BIGINT) AS form_n FROM o JOIN c ON o.word = c.word AND c.nxt IS NULL
"""
