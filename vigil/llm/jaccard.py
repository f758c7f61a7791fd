"""N-gram Jaccard join: a grouped prefix join on sets of word shingles.

1. Each text becomes its set of hashed shingles. Of the shingles in SHARE of the hash space it is counted exactly which ones no other set
   has. A set of n shingles that links with another has at most n - ceil(t * n) that the other lacks, so a set with more
   shingles of its own than that links with nothing and goes no further; no link is lost. Among the sets that are left the same
   is done with all shingles.
2. The sets that are left then are ordered: their own shingles first, which meet nothing, the others by a fixed-size sketch of their counts (rare first), so that
   what many texts share stays out of the prefixes; any order is exact, the sketch only keeps posting lists short.
3. Documents with the same prefix and size form one group; equal sets in it form one node (its id: the hash of the set).
4. Groups meet over the prefix's shingles. Posting lists of one group go at once. In the others the groups are
   linked to a hub first; the pairs are filtered by size, place and a parity bitmap of each set (its differences from another's bound
   their overlap, so nothing that links is lost) and verified on the whole sets; then connected components of the
   verified links are taken. What is left, groups of one list still in different components, is enumerated within classes of size that
   may link, filtered and verified likewise, so no link between different components is lost.
5. Groups expand to their members: every node of a group is compared with the group's first node likewise.

Pairs whose ends are in one component already are not compared: the class ids are exact, and no list is ever squared
while it is one cluster.

Defined results: a text of fewer words than a shingle has one shingle, the whole sequence; null, empty and wordless texts have none and
stand alone; a class's id is its least doc_id (null ids never name a class unless all are null); repeated rows share a class; no rows
give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import U64, Words
from .components import components

SHINGLE = 5
NUM, DEN = 80, 100
SHARE = 1 / 3
SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 16
LEAST_BITS, MOST_BITS = 6, 20


def shingle_sets(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    w = Words(texts)
    h = w.hashes()
    size = np.diff(w.bounds)
    count = np.where(size >= k, size - k + 1, (size > 0).astype(size.dtype))
    first = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(w.bounds[:-1] - first[:-1], count) + np.arange(first[-1])
    doc = np.repeat(np.arange(len(texts)), count)
    out = np.full(len(at), U64(0x51ED270B))
    length = np.minimum(size, k)[doc]
    for j in range(k):
        use = length > j
        step = common.mix64((out ^ h[np.minimum(at + j, max(0, len(h) - 1))]) * U64(0x9E3779B97F4A7C15) + U64(j + 1)) if len(h) else out
        out = np.where(use, step, out)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.append(True, (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])) if len(out) else np.zeros(0, bool)
    out, doc = out[keep], doc[keep]
    return out, np.searchsorted(doc, np.arange(len(texts) + 1))


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Shingles of which two sets that link must share one: n - ceil(t * n) + 1."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def set_ids(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit id of each set."""
    total = np.concatenate((np.zeros(1, U64), np.cumsum(common.mix64(sets * U64(0xD6E8FEB86659FD93) + U64(1)))))
    return common.mix64((total[bounds[1:]] - total[bounds[:-1]]) ^ common.mix64(np.diff(bounds).astype(U64)))


def bitmaps(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Of each set, the parity of its shingles in each of about 2n cells; cells halve by folding."""
    n = np.diff(bounds)
    log = np.clip(np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    first = np.concatenate(([0], np.cumsum(1 << log)))
    cell = ((sets & U64((1 << MOST_BITS) - 1)).astype(np.int64) & np.repeat((1 << log) - 1, n)) + np.repeat(first[:-1], n)
    packed = np.packbits((np.bincount(cell, minlength=first[-1]) & 1).astype(np.uint8))
    return [packed[a >> 3 : b >> 3].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]


def difference(x: bytes, y: bytes) -> int:
    """At most the count of shingles that are in one of the sets alone."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def sketch(docs: DataFrame) -> np.ndarray:
    """How many texts have a shingle of each of 2**SKETCH_BITS hash cells, 255 at most; 4 MB whatever the input."""
    cells = 1 << SKETCH_BITS
    blocks = cells // SKETCH_BLOCK

    def count(batches):
        total = np.zeros(cells, np.uint32)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in common.slices(texts):
                at, n = np.unique((shingle_sets(texts[a:b])[0] >> U64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                total[at] += n.astype(np.uint32)
        if total.any():
            yield pd.DataFrame({"block": range(blocks), "counts": [x.astype(np.uint8).tobytes() for x in np.minimum(total, 255).reshape(blocks, -1)]})

    def add(pdf):
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, np.uint8)
        return pd.DataFrame({"block": pdf["block"][:1], "counts": [np.minimum(total, 255).astype(np.uint8).tobytes()]})

    schema = "block int, counts binary"
    # one row a task and block, each a fixed 64 KB, added up in two steps
    parts = docs.select("text").mapInPandas(count, schema).withColumn("lane", F.pmod(F.monotonically_increasing_id() / (1 << 33), F.lit(16)).cast("int"))
    some = parts.groupBy("block", "lane").applyInPandas(lambda pdf: add(pdf[["block", "counts"]]), schema)
    out = np.zeros((blocks, SKETCH_BLOCK), np.uint8)
    for r in some.groupBy("block").applyInPandas(add, schema).collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, node, some): the set's size and id, and its shingles in SHARE of the hash space."""
    limit = U64(int(SHARE * 2**64))

    def run(batches):
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in common.slices(texts):
                sets, at = shingle_sets(texts[a:b])
                n = np.diff(at)
                # each set is ascending: what is below the limit comes first
                low = np.concatenate(([0], np.cumsum(sets < limit)))
                cut = low[at[1:]] - low[at[:-1]]
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].iloc[a:b].to_numpy(),
                        "text_hash": pdf["text_hash"].iloc[a:b].to_numpy(),
                        "n": n,
                        "node": set_ids(sets, at).view(np.int64),
                        "some": [sets[x : x + k].view(np.int64) for x, k in zip(at[:-1], cut, strict=True)],
                    }
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInPandas(run, "doc_id long, text_hash long, n long, node long, some array<long>")


def own_tokens(tokens: DataFrame) -> DataFrame:
    """(token, node) of the shingles that one set alone has. Counted by sets, not by documents: copies of a set don't hide that a shingle is its own."""
    return tokens.groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").select("token", "node")


def spare() -> Column:
    """How many of its n shingles a set may have alone and still link."""
    return F.col("n") - F.floor((F.lit(NUM) * F.col("n") + (DEN - 1)) / DEN)


def may_link(full: DataFrame) -> DataFrame:
    """(node, n, text_hash, least) of the sets that may link with another one, as far as SHARE of the hash space tells."""
    own = own_tokens(full.where("n > 0").select(F.explode("some").alias("token"), "node")).groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    sets = full.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("least"))
    return sets.join(own, "node", "left").where(F.coalesce("own", F.lit(0)) <= spare()).drop("own")


def with_own(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, text_hash, least, text, own): the wanted sets that may link with another wanted one by all their shingles, and those of their own."""

    def run(batches):
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in common.slices(texts):
                sets, at = shingle_sets(texts[a:b])
                yield pd.DataFrame({"node": pdf["node"].iloc[a:b].to_numpy(), "all": [sets[x:y].view(np.int64) for x, y in zip(at[:-1], at[1:], strict=True)]})

    tokens = texts.mapInPandas(run, "node long, all array<long>").select(F.explode("all").alias("token"), "node")
    own = own_tokens(tokens).groupBy("node").agg(F.collect_list("token").alias("own"))
    own = wanted.join(own, "node", "left").withColumn("own", F.coalesce("own", F.array().cast("array<long>")))
    return own.where(F.size("own") <= spare()).join(texts, "node")


def node_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text): one text of each wanted node; wanted: (node, text_hash)."""
    rows = common.maybe_in(docs.select(F.xxhash64("text").alias("text_hash"), "text"), wanted, "text_hash")
    return rows.groupBy("text_hash").agg(F.first("text").alias("text")).join(wanted, "text_hash").select("node", "text")


def prefix_table(texts: DataFrame, counts) -> DataFrame:
    """(node, n, grp, bits, first, prefix) of (node, text, own): grp is the hash of prefix and size.

    A set's own shingles come first in its order; `prefix` holds the others of its prefix, from place `first` on.
    """

    def run(batches):
        df = counts.value
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in common.slices(texts):
                sets, at = shingle_sets(texts[a:b])
                n = np.diff(at)
                doc = np.repeat(np.arange(len(n)), n)
                own = [np.sort(np.asarray(x, np.int64).view(U64)) for x in pdf["own"].iloc[a:b]]
                alone = np.concatenate([np.isin(sets[x:y], o, assume_unique=True) for x, y, o in zip(at[:-1], at[1:], own, strict=True)]) if len(sets) else np.zeros(0, bool)
                rare = df[(sets >> U64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((sets, rare, ~alone, doc))
                some = np.arange(len(sets)) - at[doc] < prefix_length(n)[doc]
                pre = sets[order][some]
                cut = np.concatenate(([0], np.cumsum(np.where(n > 0, prefix_length(n), 0))))
                grp = set_ids(pre, cut) ^ common.mix64(n.astype(U64) + U64(7))
                first = np.array([len(o) for o in own], np.int64)
                yield pd.DataFrame(
                    {
                        "node": pdf["node"].iloc[a:b].to_numpy(),
                        "n": n,
                        "grp": grp.view(np.int64),
                        "bits": bitmaps(sets, at),
                        "first": first,
                        "prefix": [pre[x + k : y].view(np.int64) for x, y, k in zip(cut[:-1], cut[1:], first, strict=True)],
                    }
                )

    return texts.select("node", "text", "own").mapInPandas(run, "node long, n long, grp long, bits binary, first long, prefix array<long>")


def node_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes; texts: (node, text)."""

    def run(batches):
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in common.slices(texts):
                sets, at = shingle_sets(texts[a:b])
                yield pd.DataFrame({"node": pdf["node"].iloc[a:b].to_numpy(), "shingles": [sets[x:y].view(np.int64) for x, y in zip(at[:-1], at[1:], strict=True)]})

    return common.materialise(texts.join(wanted, "node", "left_semi").mapInPandas(run, "node long, shingles array<long>"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the node pairs (a, b) those that link, by the whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    @F.pandas_udf("boolean")
    def link(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), bool)
        for i, (a, b) in enumerate(zip(x, y, strict=True)):
            both = np.concatenate((a, b))
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out[i] = DEN * shared >= NUM * (len(both) - shared)
        return pd.Series(out)

    return pairs.join(left, "a").join(right, "b").where(link("x", "y")).select("a", "b")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the node pairs (a, b) those whose bitmaps don't rule a link out."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        # 2 * overlap <= n + m - difference, and a link needs (DEN + NUM) * overlap >= NUM * (n + m)
        return pd.Series([(DEN + NUM) * (p + q - difference(a, b)) >= 2 * NUM * (p + q) for a, b, p, q in zip(x, y, n, m, strict=True)], dtype=bool)

    left = nodes.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("n").alias("p"))
    right = nodes.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("n").alias("q"))
    return pairs.join(left, "a").join(right, "b").where(near("x", "y", "p", "q")).select("a", "b")


def linked(texts: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the node pairs those that link: filtered by bitmap, then verified on the whole sets of what is left."""
    left = common.materialise(possible(pairs, nodes))
    if left.isEmpty():
        return left
    ends = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    sets = node_sets(texts, ends)
    out = common.materialise(verified(left, sets))
    common.discard(sets, left)
    return out


def size_class(n: str):
    """Sets whose classes differ by more than one are too unlike in size to link."""
    return F.floor(F.log(F.col(n) * F.lit(1.0)) / float(np.log(DEN / NUM))).cast("int")


def open_pairs(marked: DataFrame) -> DataFrame:
    """(a, b): nodes of one list in different components that may link. marked: (token, n, p, node, root).

    A list is joined with itself only between neighbouring classes of size.
    """
    one = marked.withColumn("size", size_class("n"))
    near = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))
    two = one.select("token", near.alias("size"), F.col("n").alias("n2"), F.col("p").alias("p2"), F.col("node").alias("b"), F.col("root").alias("root2"))
    test = (F.col("node") < F.col("b")) & (F.col("root") != F.col("root2")) & fits("n", "p", "n2", "p2")
    return one.join(two, ["token", "size"]).where(test).select(F.col("node").alias("a"), "b").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, root, component_id) of each document; root names the class, null without shingles."""
    spark = docs.sparkSession
    common.small_batches(spark)
    full = common.materialise(set_table(docs))
    some = common.materialise(may_link(full))
    rows = common.materialise(full.select("doc_id", "text_hash", "n", "node"))
    common.discard(full)
    near = common.materialise(node_texts(docs.select("text"), some.select("node", "text_hash")))
    texts = common.materialise(with_own(near, some))
    common.discard(some, near)
    wanted = texts.select("node", "least")
    counts = spark.sparkContext.broadcast(sketch(texts))
    nodes = common.materialise(prefix_table(texts, counts))
    counts.destroy()
    groups = nodes.groupBy("grp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("m"), F.min("n").alias("n"))
    prefixes = common.materialise(nodes.groupBy("grp").agg(F.first("prefix").alias("prefix"), F.first("first").alias("first")))
    # shingles of one group's prefix alone go before anything else is done with them
    shared = common.materialise(prefixes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token"))
    postings = common.maybe_in(prefixes.select("grp", "first", F.posexplode("prefix").alias("p", "token")), shared, "token")
    postings = postings.withColumn("p", F.col("p") + F.col("first")).drop("first")
    lists = postings.join(shared, "token").join(groups.select("grp", "rep", "n"), "grp")
    # a set that near copies were made from has no shingle of its own, so it is in the most lists: the hub to try
    lists = common.materialise(lists.withColumn("lists", F.count(F.lit(1)).over(Window.partitionBy("rep"))))
    common.discard(prefixes, shared)
    nodes_ = nodes.select("node", "n", "grp", "bits")
    inside = nodes_.join(groups.where("m > 1").select("grp", "rep"), "grp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    hubs = lists.groupBy("token").agg(F.min_by(F.struct("rep", "n", "p"), F.struct(-F.col("lists"), "rep")).alias("h"), F.count(F.lit(1)).alias("k"))
    spokes = common.join_hot(lists, hubs, "token").where((F.col("rep") != F.col("h.rep")) & fits("n", "p", "h.n", "h.p"))
    spokes = spokes.select(F.least("rep", "h.rep").alias("a"), F.greatest("rep", "h.rep").alias("b"))
    tried = common.materialise(inside.unionByName(spokes).distinct())
    links = linked(texts, tried, nodes_)
    label = components(links)
    # the rest: nodes of one list in different components, all of them; lists that are one component go before groups are expanded
    placed = common.materialise(nodes_.join(label, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("root")))
    spans = placed.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    own = groups.where("m > 1").select(F.col("grp").alias("token"), "grp", "n", F.lit(0).alias("p"))  # each group's nodes among themselves
    entries = lists.select("token", "grp", "n", "p").unionByName(own)
    open_ = entries.join(spans, "grp").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi").select("token", "k")
    marked = common.materialise(common.join_hot(entries, open_, "token").join(placed, "grp").select("token", "n", "p", "node", "root"))
    rest = common.materialise(open_pairs(marked).join(tried, ["a", "b"], "left_anti"))
    more = None
    if not rest.isEmpty():
        more = linked(texts, rest, nodes_)
        label = components(links.unionByName(more))
    # a set that links with nothing is its own class, and so is one that was not wanted
    named = wanted.select("node", "least").join(label, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = common.materialise(named.join(names, "root").select("node", "root", "component_id"))
    common.discard(nodes, lists, tried, links, label, placed, marked, rest, texts, more)
    alone = rows.where("n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    some = rows.where("n > 0")
    same = some.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k"))
    found = common.join_hot(some, same.join(ids, "node", "left").select("node", "k", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "least").alias("component_id")), "node")
    return found.select("doc_id", "text_hash", "n", "root", "component_id").unionByName(alone)


def fits(n: str, p: str, m: str, q: str):
    """Whether sets of sizes n and m may link if places p and q of their orders hold the first shingle they share.

    It holds for the first shared one of any two sets that link, so a pair that passes for none of its lists has no link.
    """
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & ((DEN + NUM) * F.least(F.col(n) - F.col(p), F.col(m) - F.col(q)) >= NUM * (F.col(n) + F.col(m)))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def near_duplicate_stage(docs: DataFrame) -> DataFrame:
    """Keeps one document of each class, that of the least id (of equal ids, of the least text hash; of equal rows, one).

    Documents without shingles link with nothing and stay.
    """
    found = common.materialise(classes(docs.select("doc_id", "text")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash"))
    keep = found.where("n > 0").groupBy("root").agg(least.alias("k")).select(F.xxhash64("k.doc_id", "k.text_hash").alias("key"), F.lit(True).alias("one"))
    alone = found.where("n = 0").select(F.xxhash64("doc_id", "text_hash").alias("key"), F.lit(False).alias("one")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"))
    kept = rows.join(keep.unionByName(alone), "key").withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("one")))
    return kept.where("at = 1 OR NOT one").select("doc.*")
