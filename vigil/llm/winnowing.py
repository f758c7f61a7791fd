"""Document fingerprints by winnowing.

Rolling hashes of all KGRAM code points are taken; from every window of WINDOW hashes the least is chosen, the rightmost of equal
ones, and its position is kept. Texts that share KGRAM + WINDOW - 1 code points therefore share a fingerprint. A text shorter than
one k-gram has the hash of the whole; one with fewer hashes than a window has one window.

The query also needs the next document. Documents are dealt into ranges of doc_id whose bounds are ids of the table (as many
as there are partitions), the first document of each range goes to the range before as well, and each range is read in order: the
texts are shuffled once, and no task or driver holds more than one range.

Defined results: null counts as the empty text, whose fingerprint is that of no hashes; null ids come first; rows of one id are in order of
their text; the last row's next is the first, a single row's is itself. Two texts without hashes are alike (1), one
without and one with are not (0). No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64

KGRAM = 16
WINDOW = 16
_BASE = 0x9E3779B97F4A7C15


def kgram_hashes(text: str, k: int = KGRAM) -> np.ndarray:
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    k = min(k, len(h))
    done, rest, out = 1, k, None  # hashes of `done` code points; joined by the binary digits of k
    at = 0
    while rest:
        if rest & 1:
            power = U64(pow(_BASE, done, 1 << 64))
            if out is None:
                out, at = h, done
            else:
                n = len(out) - done
                out = out[:n] * power + h[at : at + n]
                at += done
        rest >>= 1
        if rest:
            h = h[: len(h) - done] * U64(pow(_BASE, done, 1 << 64)) + h[done:]
            done *= 2
    return common.mix64(out + U64(k)) if out is not None else np.zeros(0, U64)


def winnow(text: str, k: int = KGRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions."""
    h = kgram_hashes(text, k)
    w = min(w, len(h))
    if not w:
        return h, np.zeros(0, np.int64)
    least, at = h, np.arange(len(h))
    done = 1
    while done < w:
        step = min(done, w - done)
        left, right = least[: len(least) - step], least[step:]
        take = right <= left
        at = np.where(take, at[step:], at[: len(at) - step])
        least = np.where(take, right, left)
        done += step
    at = at[np.append(True, at[1:] != at[:-1])]
    return h[at], at


def digest(chosen: tuple[np.ndarray, np.ndarray]) -> str:
    return hashlib.blake2b(chosen[0].tobytes() + chosen[1].astype(np.int64).tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct hashes of both that are in both; a and b are sorted and distinct."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common_ = int((both[1:] == both[:-1]).sum())
    return common_ / (len(both) - common_)


def ranges(docs: DataFrame, parts: int) -> tuple[list[int], int | None, bool]:
    """Ids at which ranges 1.. begin, the least id, and whether there are null ids."""
    probabilities = [i / parts for i in range(1, parts)] or [0.5]
    r = docs.select("doc_id").agg(
        F.percentile_approx("doc_id", F.array(*map(F.lit, probabilities)), F.lit(max(10_000, 20 * parts))).alias("q"),
        F.min("doc_id").alias("least"),
        F.max(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    nulls = bool(r["nulls"])
    return sorted({q for q in r["q"] or [] if parts > 1 and (nulls or q > r["least"])}), r["least"], nulls


def in_order(docs: DataFrame) -> DataFrame:
    """(range, tail, doc_id, text), each partition's ranges in order; tail rows are the first of the next range."""
    spark = docs.sparkSession
    common.small_batches(spark)
    parts = common.parallelism(spark)
    starts, least, nulls = ranges(docs, parts)
    bounds, last = np.array(starts, np.int64), len(starts)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        null = ids.isna().to_numpy()
        x = ids.fillna(0).astype("int64").to_numpy()
        at = np.searchsorted(bounds, x, "right")
        at[null] = 0
        opens = (at > 0) & (bounds[np.maximum(at - 1, 0)] == x) if last else np.zeros(len(x), bool)
        opens |= null if nulls else x == least
        return pd.Series((2 * at + opens).astype("int32"))

    placed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("place", place("doc_id"))
    at = F.shiftright("place", 1)
    own = F.struct(at.alias("range"), F.lit(0).alias("tail"))
    before = F.struct(F.when(at > 0, at - 1).otherwise(last).alias("range"), F.lit(1).alias("tail"))
    both = placed.withColumn("to", F.explode(F.when(F.col("place") % 2 == 1, F.array(own, before)).otherwise(F.array(own))))
    return both.select("to.range", "to.tail", "doc_id", "text").repartitionById(parts, F.col("range")).sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The operator's own output: (doc_id, hashes, positions) of each text."""

    def run(batches):
        for pdf in batches:
            found = [winnow(t or "") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "hashes": [h.view(np.int64) for h, _ in found], "positions": [p for _, p in found]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, hashes array<long>, positions array<long>")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(batches):
    """Streams rows in order; each waits for the next one's text."""
    names = [c.split()[0] for c in _OUT.split(", ")]
    waiting, now = None, None
    for pdf in batches:
        out = []
        for rng, tail, doc_id, text in pdf.itertuples(index=False, name=None):
            if rng != now:
                waiting, now = None, rng
            elif waiting is None:
                continue  # further tails of a repeated id
            chosen = winnow(text)
            mine = np.unique(chosen[0])
            if waiting is not None:
                who, old, old_chosen, old_set = waiting
                half = len(old) // 2
                edited = old[: len(old) - half] + text[:half]
                new = winnow(edited)
                out.append(
                    (
                        who,
                        len(old),
                        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        digest(old_chosen),
                        digest(new),
                        likeness(old_set, np.unique(new[0])),
                        likeness(old_set, mine),
                    )
                )
            waiting = None if tail else (doc_id, text, chosen, mine)
        frame = pd.DataFrame(out, columns=names)
        yield frame.assign(doc_id=frame["doc_id"].astype("Int64"), n_chars=frame["n_chars"].astype("int64"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(common.table(spark, sf_dir, "documents")).mapInPandas(with_edits, _OUT)
