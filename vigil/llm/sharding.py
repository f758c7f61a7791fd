"""Sharding: minimax contiguous partition of groups of equal texts.

Groups (equal texts, keyed by a 64-bit hash whose signed order is the group order) are cut into contiguous shards of the
least possible capacity. The driver holds a histogram of the key space of bounded size, never the groups: cells
that may hold a cut are refined until each holds one group, the least feasible capacity is found by binary search with
a greedy check, and the cuts are laid within it as evenly as it allows.

Defined results: a null text has 0 bytes and is a text of its own, apart from the empty one; repeated rows are rows; no rows give no
rows; columns beside doc_id and text are ignored. Ties in a slot's order are broken by doc_id, then checksum.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 24
CELL_BITS = 12
REFINE_BITS = 8
SLOT_CELLS = 2048


def greedy(prefix: list[int], capacity: int, start: int = 0) -> list[int]:
    """Cell positions after which each shard ends; a cell above the capacity makes it infeasible (empty list)."""
    cuts, at, n = [], start, len(prefix) - 1
    while at < n:
        nxt = bisect_right(prefix, prefix[at] + capacity) - 1
        if nxt == at:
            return []
        cuts.append(nxt)
        at = nxt
    return cuts


def least_capacity(prefix: list[int], shards: int, low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        cuts = greedy(prefix, mid)
        if cuts and len(cuts) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def even_cuts(prefix: list[int], shards: int, capacity: int) -> list[int]:
    """Shard ends within the capacity, each as near to the mean of what is left as the rest allows."""
    cuts, at, n = [], 0, len(prefix) - 1
    for left in range(shards, 0, -1):
        if left == 1 or at >= n:
            cuts.append(n)
            at = n
            continue
        most = bisect_right(prefix, prefix[at] + capacity) - 1
        aim = prefix[at] + (prefix[n] - prefix[at]) / left
        pos = min(most, max(at, bisect_right(prefix, aim) - 1))
        if pos < most and prefix[pos + 1] - aim < aim - prefix[pos]:
            pos += 1
        while pos < most and (rest := greedy(prefix, capacity, pos)) is not None and (pos < n and not rest or len(rest) > left - 1):
            pos += 1
        cuts.append(pos)
        at = pos
    return cuts


def plan_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Keys at which shards 1.. begin, and the least capacity."""
    cell = lambda shift: F.shiftright("gkey", shift)
    summary = [F.sum("bytes").cast("long").alias("b"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("m"), F.min("gkey").alias("k")]
    shift = 64 - CELL_BITS
    rows = groups.groupBy(cell(shift).alias("cell")).agg(*summary).collect()
    # (first key of the cell's range, shift, bytes, groups, largest group); the first key present orders the cells
    cells = sorted((r["k"], shift, r["cell"], r["b"], r["n"], r["m"]) for r in rows)
    if not cells:
        return [], 0
    while True:
        prefix = [0]
        for c in cells:
            prefix.append(prefix[-1] + c[3])
        total = prefix[-1]
        low = max(-(-total // shards), max(c[5] for c in cells))
        high = least_capacity(prefix, shards, low, total)
        wanted, lo, hi = set(), 0, 0
        for _ in range(shards):
            lo = prefix[max(0, bisect_right(prefix, min(total, lo + low)) - 1)]
            hi = min(total, hi + high)
            for i in range(max(0, bisect_right(prefix, lo) - 1), len(cells)):
                if prefix[i] > hi:
                    break
                if cells[i][4] > 1 and cells[i][1] > 0:
                    wanted.add(i)
        if not wanted or high == low:
            break
        by_shift: dict[int, list[int]] = {}
        for i in wanted:
            by_shift.setdefault(cells[i][1], []).append(cells[i][2])
        new = []
        for old, ids in by_shift.items():
            finer = max(0, old - REFINE_BITS)
            some = groups.sparkSession.createDataFrame([(i,) for i in ids], "cell long")
            got = groups.withColumn("cell", cell(old)).join(F.broadcast(some), "cell").groupBy(cell(finer).alias("fine")).agg(*summary).collect()
            new += [(r["k"], finer, r["fine"], r["b"], r["n"], r["m"]) for r in got]
        cells = sorted([c for i, c in enumerate(cells) if i not in wanted] + new)
    ends = even_cuts(prefix, shards, high)
    return [cells[e][0] if e < len(cells) else 2**63 - 1 for e in ends[:-1]], high


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds to (doc_id, size, text_crc32) the shard and the gapless slot; law `bytes`."""
    rows = common.materialise(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("gkey"),
        )
    )
    groups = common.materialise(rows.groupBy("gkey").agg(F.sum("size").alias("bytes")))
    starts, _ = plan_cuts(groups, shards)
    common.discard(groups)
    shard = F.lit(0)
    for k in starts:
        shard = shard + (F.col("gkey") >= F.lit(k).cast("long")).cast("int") if k < 2**63 - 1 else shard
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_CELLS)).cast("int"))
    # at most shards * SLOT_CELLS rows: bounded whatever the input
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return placed.withColumn("at", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.table(spark, sf_dir, "documents"))
