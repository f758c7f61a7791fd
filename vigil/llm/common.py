"""Helpers shared by the training-data operators: tables, materialisation, vectorised hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only where none is set and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="vigil-")
        shared_dir.own = found
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes a compact table to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vigil/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vigil_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes tables of materialise() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_vigil_path", None) if df is not None else None
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


BITMAP_BITS = 27


def _in_bitmaps(rows: DataFrame, wanted: DataFrame, key: str, how: str) -> DataFrame:
    """The rows with _in: whether the bit of `key` is set; with a left join null where no bit near it is."""
    cell = F.pmod(key, F.lit(1 << BITMAP_BITS))
    place = F.shiftright(cell, 15).cast("int").alias("_bucket"), F.pmod(cell, F.lit(1 << 15)).alias("_bit")
    bitmaps = wanted.select(*place).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod("_bit", F.lit(8)))), F.lit(2)) == 1
    return rows.select("*", *place).join(F.broadcast(bitmaps), "_bucket", how).withColumn("_in", is_set).drop("_bucket", "_bit", "_bits")


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose hash `key` (a long) may be among the wanted ones: by bitmaps of 2**BITMAP_BITS bits (16 MB) in all whatever the input.

    A row that is wanted always stays; an exact join is to follow.
    """
    return _in_bitmaps(rows, wanted, key, "inner").where("_in").drop("_in")


def not_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows that maybe_in() leaves out; none of them is wanted."""
    return _in_bitmaps(rows, wanted, key, "left").where(~F.coalesce("_in", F.lit(False))).drop("_in")


HOT_ROWS, HOT_KEYS = 1000, 1000


def join_hot(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Joins rows, of which one key may hold very many, with a table of one row a key (and k, the key's count of rows, if it is known).

    The HOT_KEYS keys of the most rows, if of more than hot_rows, are joined by broadcast of those keys alone, so no task gets all of one key.
    """
    counts = unique if "k" in unique.columns else rows.groupBy(key).agg(F.count(F.lit(1)).alias("k"))
    hot = materialise(counts.where(F.col("k") > hot_rows).orderBy(F.desc("k"), key).limit(HOT_KEYS).select(key))
    unique = unique.drop("k")
    if hot.isEmpty():
        return rows.join(unique, key, how)
    few = F.broadcast(unique.join(F.broadcast(hot), key, "left_semi"))  # at most HOT_KEYS rows
    found = rows.join(F.broadcast(hot), key, "left_semi").join(few, key, how)
    return found.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(unique, key, how))


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than the session's setting: rows are whole texts, and batches stand in workers' memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


TRAIN_CHARS = 100_000


def lowest(rows: DataFrame, by: str, limit: int, most: int) -> DataFrame:
    """Distinct rows of (doc_id, by) with the `limit` lowest id hashes of each of the first `most` values.

    Hashes are even, so the lowest lie below a bound that the value's count of ids gives: twice `limit` and 100 ids of a value, on average, are sorted in
    one task, whatever the input (that fewer than `limit` lie below it has a chance of e**-50 or less).
    """
    hashed = rows.select("doc_id", by, F.xxhash64("doc_id").alias("h"))
    counts = hashed.groupBy(by).agg(F.approx_count_distinct("doc_id", 0.02).alias("_n")).orderBy(by).limit(most).withColumnRenamed(by, "_by")
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    low = hashed.join(F.broadcast(counts), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")  # at most `most` rows
    low = low.where(share * F.col("_n") <= 2 * limit + 100).groupBy(by, "h", "doc_id").agg(F.count(F.lit(1)).alias("_k"))
    at = F.row_number().over(Window.partitionBy(by).orderBy("h", "doc_id"))
    return low.withColumn("_at", at).where(F.col("_at") <= limit).select("doc_id", by, "h")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, limit: int) -> tuple[list[str], list[str]]:
    """Texts of at most `limit` labelled rows of each class outside the held-out fold; lowest id hash first.

    The bound is a parameter of each classifier, and so is TRAIN_CHARS: longer texts are scored, but take no part in training, so that the sample's size on
    the driver is bounded. Ids only choose rows, they are no input of a model.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", folds) != 0)).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = lowest(usable.groupBy("doc_id").agg(F.max("y").alias("y")), "y", limit, 2)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS)).join(F.broadcast(chosen), "doc_id")
    found = rows.orderBy("h", "text").limit(2 * limit).select("y", "text").collect()
    return [r.text for r in found if not r.y], [r.text for r in found if r.y]


def slices(texts: list[str], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` characters; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 19)
        base = 0x5851F42D4C957F2D
        rows = [np.full(size, b, U64) for b in (base, pow(base, -1, 1 << 64))]
        for x in rows:
            x[0] = 1
            np.cumprod(x, out=x)
        _POWERS[:] = rows
    return _POWERS[0], _POWERS[1]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


NOT_ALNUM = np.arange(256) < 128
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


class Words:
    """Words of several texts at once: byte bounds, 64-bit hashes, and each text's range of words."""

    def __init__(self, texts: list[str], breaks: np.ndarray = SPACE):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
        self.data = LOWER[self.raw]
        first = np.concatenate(([1], 1 + np.cumsum(lens + 1)))
        inside = ~breaks[self.data]
        inside[first - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8)))))
        self.start, self.end = edge[::2], edge[1::2]
        self.bounds = np.searchsorted(self.start, first)

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        total = _BYTE[self.data]
        total *= up[: len(total)]
        total = np.concatenate((np.zeros(1, U64), np.cumsum(total)))
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix64(h ^ (self.end - self.start).astype(U64))


def adam(params: list[np.ndarray], grads: list[np.ndarray], state: dict, rate: float, b1: float = 0.9, b2: float = 0.999) -> None:
    """One step, in place."""
    t = state["t"] = state.get("t", 0) + 1
    for i, (p, g) in enumerate(zip(params, grads, strict=True)):
        m, v = state.setdefault(i, (np.zeros_like(p), np.zeros_like(p)))
        m += (1 - b1) * (g - m)
        v += (1 - b2) * (g * g - v)
        p -= rate * (m / (1 - b1**t)) / (np.sqrt(v / (1 - b2**t)) + 1e-8)


def score_texts(docs: DataFrame, score, folds: int, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted); score: list of texts -> array of probabilities."""
    import pandas as pd

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            parts = [score(texts[a:b]) for a, b in slices(texts)]
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": p.astype(float), "predicted": (p >= threshold).astype("int32")})

    held = docs.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "text")
    return held.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
