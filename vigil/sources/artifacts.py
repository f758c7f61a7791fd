"""Published artifacts: staged, put in place by renaming, and written only if they say something new.

An artifact is a folder of one table. It is written beside its place under a name of its own, with its signature, and renamed into place when it is whole: a writer
that is lost leaves what was there. An empty table never replaces one with rows, and a table of the same signature (columns that only tell the time left out) is not
written again. A writer lost between the two renames leaves the old folder aside; the next call puts it back.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

VOLATILE = ("generated_at", "updated_at")


def signature(df: DataFrame, volatile: tuple[str, ...] = VOLATILE) -> str:
    """Of a table's rows in any order, by their JSON; maps count in the order of their keys."""

    def fixed(name: str):
        kind = df.schema[name].dataType
        return F.array_sort(F.map_entries(name)).alias(name) if isinstance(kind, T.MapType) else F.col(name)

    row = F.to_json(F.struct(*[fixed(c) for c in sorted(df.columns) if c not in volatile]), {"ignoreNullFields": "false"})
    r = df.select(F.xxhash64(row).alias("a"), F.xxhash64(row, F.lit(1)).alias("b")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "ab"]).first()
    return f"{r.n}:{r.a}:{r.b}"


def current(spark: SparkSession, path: str) -> dict | None:
    """{signature, rows} of what is in place."""
    _restore(spark, path)
    if not scratch.exists(spark, f"{path}/_signature"):
        return None
    return json.loads(scratch.read_text(spark, f"{path}/_signature"))


def _restore(spark: SparkSession, path: str) -> None:
    folder, _, name = path.rstrip("/").rpartition("/")
    if scratch.exists(spark, path):
        return
    aside = [n for n in scratch.names(spark, folder) if n.startswith(f"_old-{name}-")]
    if aside:
        scratch.rename(spark, f"{folder}/{aside[-1]}", path)


def publish(df: DataFrame, path: str, kind: str = "json", files: int | None = 1, volatile: tuple[str, ...] = VOLATILE) -> str:
    """Writes a table as json, csv (with a header; arrays joined by bars) or text; tells what it did: written, unchanged, or refused for being empty.

    files: how many files; None leaves the table's own partitions, for tables too large for one task.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    before, mark = current(spark, path), signature(df, volatile)
    rows = int(mark.split(":")[0])
    if not rows and before and before["rows"]:
        return "refused"
    if before and before["signature"] == mark:
        return "unchanged"
    folder, _, name = path.rpartition("/")
    staged = f"{folder}/_staged-{name}-{uuid.uuid4().hex}"
    out = df if files is None else df.coalesce(files)
    if kind == "csv":
        flat = [F.array_join(c, " | ").alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c) for c in df.columns]
        out.select(*flat).write.option("header", "true").csv(staged)
    else:
        out.write.format(kind).save(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    f = fs.create(hadoop(f"{staged}/_signature"), False)
    f.write(bytearray(json.dumps({"signature": mark, "rows": rows}).encode()))
    f.close()
    aside = f"{folder}/_old-{name}-{uuid.uuid4().hex}"
    if scratch.exists(spark, path):
        scratch.rename(spark, path, aside)
    if not scratch.rename(spark, staged, path):
        _restore(spark, path)
        raise RuntimeError(f"another writer put {path} in place")
    if scratch.exists(spark, aside):
        scratch.delete(spark, aside)
    return "written"


def publish_all(spark: SparkSession, place: str, tables: dict[str, DataFrame], kinds: dict[str, str] | None = None) -> dict[str, str]:
    """Each artifact under its name; one that fails is told as `failed: ...` and leaves the others alone."""
    out = {}
    for name, df in tables.items():
        try:
            out[name] = publish(df, f"{place.rstrip('/')}/{name}", (kinds or {}).get(name, "json"))
        except Exception as e:  # told, not swallowed
            out[name] = f"failed: {type(e).__name__}: {e}"[:300]
    return out


def trace(items: DataFrame, order: list, most: int = 1200) -> DataFrame:
    """The first `most` items of a trace."""
    return items.orderBy(*order).limit(most)
