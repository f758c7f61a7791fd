"""Structured Streaming forms of the stateful parts: each runs what there is and leaves a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import STORIES, table


def _place(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="vigil-stream-")
    return f"{base.rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    path = f"{sf_dir}/events.parquet"
    return raw.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, place: str, mode: str = "append") -> None:
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def story_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends each story once (dropping repeated ids within the watermark), then counts by action."""
    place = _place(spark, "stories")
    once = events(spark, sf_dir).withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"])
    _run(spark.sql(STORIES, events=once), place)
    return spark.read.parquet(f"{place}/out").groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows kept by a batch function that merges each micro-batch's partial counts into a table."""
    place = _place(spark, "days")

    def merge(batch: DataFrame, epoch: int) -> None:
        part = batch.groupBy("event_type", F.window("ts", "1 day").start.alias("day")).agg(F.count(F.lit(1)).alias("n"))
        part.write.mode("overwrite").parquet(f"{place}/out/epoch={epoch}")  # a repeated epoch replaces itself

    q = events(spark, sf_dir).writeStream.foreachBatch(merge).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("event_type", "day").agg(F.sum("n").alias("n"))
