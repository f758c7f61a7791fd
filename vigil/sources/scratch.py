"""Tables that cut lineage: written to the folder all executors share, so that an executor that is lost costs only the tasks it ran."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a private folder only where none is set and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="vigil-")
        shared_dir.own = found
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Atomic in file systems that rename atomically; False if the new name is taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(old).getFileSystem(spark._jsc.hadoopConfiguration())
    return False if fs.exists(hadoop(new)) else bool(fs.rename(hadoop(old), hadoop(new)))


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table written and read back; at a given path it replaces what a lost attempt left there. The shuffle files of the write go with its end."""
    path = path or f"{shared_dir(df.sparkSession)}/scratch/{uuid.uuid4().hex}"
    was = df.sparkSession.conf.get(CLEAN_UP, "false")
    df.sparkSession.conf.set(CLEAN_UP, "true")
    try:
        df.select("*").write.mode("overwrite").parquet(path)  # a new frame takes the setting
    finally:
        df.sparkSession.conf.set(CLEAN_UP, was)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            delete(df.sparkSession, path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, hidden ones too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
