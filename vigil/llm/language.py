"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties on at most SAMPLE documents of each language (lowest id
hash; texts of more than common.TRAIN_CHARS signs take no part in training; of more than ten languages each has its
share of SAMPLE_IN_ALL documents, and past MOST_LANGUAGES those last in the alphabet are not learnt), then calibrated with one temperature on a part of them that training leaves out. Every document is scored over its
whole text.

Defined results: null text or no letter: `und`, score 0. No usable training row: `und` everywhere. A null doc_id counts as
the empty text in the fold. Repeated rows are scored alike; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 600
BUCKETS = 1 << 14
ORDERS = 3
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-2, 1e-4
MOST_LANGUAGES = 500
SAMPLE_IN_ALL = 6000
_SHIFT = np.uint32(32 - 14)
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]
# letters as they are, everything else a space
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a text in lower case, with other signs as spaces, and their counts."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _FOLD[code]
    h, found = code * _ODD[1], []
    for n in range(min(ORDERS, len(code))):
        if n:
            h = h[:-1] * _ODD[0]
            h += code[n:]
        x = h ^ (h >> np.uint32(15))
        x *= _ODD[2]
        x >>= _SHIFT
        found.append(x)
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


class Model:
    def __init__(self, classes: list[str]):
        self.classes = classes
        self.idf = np.ones(BUCKETS)
        self.w = np.zeros((BUCKETS, len(classes)))
        self.temperature = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = grams(text)
        v = (1 + np.log(n)) * self.idf[at]
        return at, v / max(np.sqrt(v @ v), 1e-12)

    def logits(self, text: str) -> np.ndarray:
        at, v = self.vector(text)
        return v @ self.w[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.classes or text is None or next(filter(str.isalpha, text), None) is None:
            return "und", 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(np.argmax(p))
        return self.classes[k], float(min(1.0, p[k]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """rows: (language, text)."""
    model = Model(sorted({y for y, _ in rows}))
    if not rows:
        return model
    k = len(model.classes)
    df = np.zeros(BUCKETS)
    for _, t in rows:
        df[grams(t)[0]] += 1
    model.idf = np.log((1 + len(rows)) / (1 + df)) + 1
    data = [(model.classes.index(y), *model.vector(t)) for y, t in rows]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    held = order[: len(data) // 5] if len(data) >= 50 else order
    used = order[len(data) // 5 :] if len(data) >= 50 else order
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))

    def weights(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            y, at, v = data[i]
            w = weights(at)
            p = softmax(v @ w)
            p[y] -= 1
            g = np.outer(v, p)
            root = np.sqrt(n[at])
            sigma = (np.sqrt(n[at] + g * g) - root) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    model.w = weights(np.arange(BUCKETS)).astype(np.float32)
    x = np.array([v @ model.w[at] for _, at, v in (data[i] for i in held)])
    y = np.array([data[i][0] for i in held])
    loss = lambda t: -np.mean(np.log(softmax(x / t)[np.arange(len(y)), y] + 1e-12))
    # the least temperature with the least loss; one below 0.05 would only sharpen what is already certain
    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    model.idf = model.idf.astype(np.float32)
    return model


def fit(docs: DataFrame, usable=None, sample: int = SAMPLE) -> Model:
    """usable: which documents may be learnt from."""
    rows = docs.where(F.col("lang").isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    languages = min(MOST_LANGUAGES, rows.agg(F.approx_count_distinct("lang").alias("n")).first()["n"])
    sample = max(1, min(sample, SAMPLE_IN_ALL // max(1, languages)))
    chosen = common.lowest(rows.select("doc_id", "lang"), "lang", sample, MOST_LANGUAGES).select("doc_id").distinct()
    found = (
        rows.where(F.col("text").isNotNull() & (F.length("text") <= common.TRAIN_CHARS))
        .select("doc_id", "lang", "text")
        .join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "text")
        .limit(SAMPLE_IN_ALL)
        .select("lang", "text")
        .collect()
    )
    return train([(r.lang, r.text) for r in found if any(map(str.isalpha, r.text))])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to the documents, in place of columns of those names."""
    docs = docs.drop("lang_pred", "score")
    common.small_batches(docs.sparkSession)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, lang_pred string, score double"

    def run(batches):
        for pdf in batches:
            found = [model.predict(t) for t in pdf["text"]]
            yield pdf.assign(lang_pred=[f[0] for f in found], score=pd.Series([f[1] for f in found], dtype="float64", index=pdf.index))

    return docs.mapInPandas(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = common.fold("doc_id", 3) == 1
    model = fit(docs.select("doc_id", "text", "lang"), ~held)
    scored = identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")


def language_stage(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Keeps the documents whose language is recognised; every column and every kept row as it was."""
    common.small_batches(docs.sparkSession)
    usable = common.fold("doc_id", 3) != 1
    model = fit(docs.select("doc_id", "text", "lang"), usable)

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        found = [model.predict(t) for t in text]
        return pd.Series([lang != "und" and p >= least for lang, p in found])

    return docs.where(known("text"))
