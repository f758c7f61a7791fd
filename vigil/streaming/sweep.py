"""Sweeps over a stream of items: the seen set and the backlog as state across micro-batches.

Each micro-batch is one sweep. Items whose URL was processed before are out; of the rest, those that pass the pre-filter compete with the backlog's for the cap's
places. The winners become seen. The others are the next backlog: deferred, not dropped, they compete again, for AGE days after they were last deferred
and up to SIZE of them, best first.

The seen set is a keyed table, of which a sweep rewrites the touched buckets alone; the backlog is bounded by SIZE. Both are written under the epoch's
name: a repeated epoch reads the state before it and gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import prefilter
from ..sources import scratch
from ..sources.keyed import KeyedTable

AGE, SIZE, CAP = 21, 600, 15
FIELDS = ["url", "source", "title", "summary", "published"]


class Sweeper:
    """judge: items (FIELDS, arrival_idx, carried) -> the same with keep, priority and score; items that are carried over have been kept before."""

    def __init__(self, spark: SparkSession, place: str, judge, cap: int = CAP, age: int = AGE, size: int = SIZE):
        self.spark, self.place, self.judge, self.cap, self.age, self.size = spark, place.rstrip("/"), judge, cap, age, size
        self.seen = KeyedTable(spark, f"{self.place}/seen", ["url"], "url string, epoch long")

    def _backlog_path(self, epoch: int) -> str:
        return f"{self.place}/backlog/epoch-{epoch + 1:012d}"

    def backlog(self, before: int) -> DataFrame:
        """(FIELDS, queued_at, place) as the last epoch left it, best first."""
        schema = ", ".join(f"{f} string" for f in FIELDS) + ", queued_at timestamp, place int"
        found = [int(n.removeprefix("epoch-")) - 1 for n in scratch.names(self.spark, f"{self.place}/backlog") if n.startswith("epoch-")]
        last = [e for e in sorted(found) if e < before]
        return self.spark.read.schema(schema).parquet(self._backlog_path(last[-1])) if last else self.spark.createDataFrame([], schema)

    def sweep(self, items: DataFrame, epoch: int, now: Column) -> DataFrame:
        """(FIELDS, score, carried, rank) of this sweep's candidates; items: FIELDS and arrival_idx, which is distinct."""
        seen = self.seen.read().where(F.col("epoch") < epoch).select("url")
        fresh = prefilter.first_per(items.where(T.filled("url") != ""), "url", ["arrival_idx"]).join(seen, "url", "left_anti")
        fresh = fresh.select(*FIELDS, F.col("arrival_idx").cast("long").alias("arrival_idx"), F.lit(False).alias("carried"))
        kept = scratch.stored(self.judge(fresh).where("keep").select(*FIELDS, "arrival_idx", "carried", "priority", "score"))
        young = self.backlog(epoch).where(F.col("queued_at") >= now - F.expr(f"INTERVAL {self.age} DAYS"))
        carried = young.join(seen, "url", "left_anti").join(kept.select("url"), "url", "left_anti")
        carried = self.judge(carried.select(*FIELDS, F.col("place").cast("long").alias("arrival_idx"), F.lit(True).alias("carried")))
        carried = carried.select(*FIELDS, "arrival_idx", "carried", F.lit(0).alias("priority"), "score")
        # no more than the cap and the backlog's size are wanted: a top-k, of which each task keeps as many
        order = [F.desc("score"), F.asc("carried"), F.desc("priority"), F.asc("arrival_idx")]
        top = kept.unionByName(carried).orderBy(*order).limit(self.cap + self.size)
        top = scratch.stored(top.withColumn("rank", F.row_number().over(Window.orderBy(*order))))
        chosen = top.where(F.col("rank") <= self.cap)
        out = scratch.stored(chosen.select(*FIELDS, "score", "carried", "rank"), f"{self.place}/candidates/epoch-{epoch + 1:012d}")
        deferred = top.where(F.col("rank") > self.cap).withColumn("summary", F.left("summary", F.lit(600)))
        scratch.stored(deferred.select(*FIELDS, now.cast("timestamp").alias("queued_at"), (F.col("rank") - self.cap).cast("int").alias("place")), self._backlog_path(epoch))
        self.seen.upsert(out.select("url", F.lit(epoch).cast("long").alias("epoch")), ignore=True, name=f"epoch-{epoch}")
        scratch.discard(kept, top)
        return out

    def attach(self, stream: DataFrame, now, state: str | None = None):
        """Sweeps once for each micro-batch of a stream; now: epoch -> the sweep's time (a Column)."""
        query = stream.writeStream.foreachBatch(lambda batch, epoch: self.sweep(batch, epoch, now(epoch)) and None)
        return query.option("checkpointLocation", state or f"{self.place}/progress").trigger(availableNow=True).start()

    def results(self) -> DataFrame:
        """The candidates of all sweeps, with their epoch."""
        parts = [n for n in scratch.names(self.spark, f"{self.place}/candidates") if n.startswith("epoch-")]
        out = None
        for n in parts:
            rows = self.spark.read.parquet(f"{self.place}/candidates/{n}").withColumn("epoch", F.lit(int(n.removeprefix("epoch-")) - 1).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return out
