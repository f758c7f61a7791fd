"""Quality: a byte-level convolutional network, trained and run in numpy.

FILTERS learned filters of KERNEL bytes run over overlapping chunks of CHUNK bytes, STEP apart, that cover the whole document. Each
filter is max-pooled in its chunk; the mean and the highest of the chunks' vectors go through a small layer to one
probability. Trained on at most SAMPLE documents of each class.

Defined results: null counts as the empty text, which has one empty chunk; without rows of both classes every score is the share of
label 1 that there is (0.5 without labels); repeated rows score alike; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common

SAMPLE = 1500
KERNEL, FILTERS, HIDDEN = 8, 16, 16
CHUNK, STEP = 512, 448
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.01, 0.05
FOLDS = 5


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each chunk's start and length in them, and its document."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw) + bytes(CHUNK + KERNEL), np.uint8)
    start, length, doc, at = [], [], [], 0
    for d, r in enumerate(raw):
        n = len(r)
        k = 1 + max(0, -(-(n - CHUNK) // STEP))
        own = np.arange(k) * STEP
        start.append(at + own)
        length.append(np.minimum(CHUNK + KERNEL - 1, n - own))
        doc.append(np.full(k, d))
        at += n
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return data, cat(start), cat(length), cat(doc)


class Network:
    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        f = lambda *s, k=0.1: rng.normal(0, k, s).astype(np.float32)
        self.filters = f(KERNEL, 256, FILTERS, k=0.3)
        self.w, self.b = f(2 * FILTERS, HIDDEN, k=0.2), np.zeros(HIDDEN, np.float32)
        self.v, self.c = f(HIDDEN, k=0.3), np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.filters, self.w, self.b, self.v, self.c]

    def pooled(self, data, start, length, where: bool = False):
        """Each chunk's highest filter values, and with `where` their places and the chunk's bytes."""
        out = np.empty((len(start), FILTERS), np.float32)
        places, blocks = [], []
        for i in range(0, len(start), 64):
            own = slice(i, i + 64)
            x = data[start[own, None] + np.arange(CHUNK + KERNEL - 1)]
            x[np.arange(CHUNK + KERNEL - 1) >= length[own, None]] = 0  # beyond the document
            sums = self.filters[0].take(x[:, :CHUNK], 0)
            part = np.empty_like(sums)
            for j in range(1, KERNEL):
                sums += np.take(self.filters[j], x[:, j : j + CHUNK], 0, out=part, mode="clip")
            if where:
                at = sums.argmax(1)
                places.append(at)
                blocks.append(x)
            out[own] = sums.max(1)
        return (out, np.concatenate(places), np.concatenate(blocks)) if where else out

    def head(self, pooled: np.ndarray, doc: np.ndarray, n: int):
        act = np.tanh(pooled)
        first = np.searchsorted(doc, np.arange(n))
        count = np.diff(np.append(first, len(doc)))[:, None].astype(np.float32)
        both = np.concatenate((np.add.reduceat(act, first) / count, np.maximum.reduceat(act, first)), 1)
        hid = np.tanh(both @ self.w + self.b)
        return hid @ self.v + self.c[0], (act, first, count, both, hid)

    def gradients(self, texts: list[str], y: np.ndarray) -> list[np.ndarray]:
        data, start, length, doc = chunks(texts)
        pooled, at, x = self.pooled(data, start, length, True)
        logit, (act, first, count, both, hid) = self.head(pooled, doc, len(texts))
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
        dh = d[:, None] * self.v * (1 - hid * hid)
        db = dh @ self.w.T
        dact = (db[:, :FILTERS] / count)[doc]
        top = (act == both[doc, FILTERS:]) * db[doc, FILTERS:]
        dpool = (dact + top) * (1 - act * act)
        df = np.zeros_like(self.filters)
        k = np.arange(FILTERS)
        for j in range(KERNEL):
            np.add.at(df[j], (x[np.arange(len(x))[:, None], at + j], k), dpool)
        return [df, both.T @ dh, dh.sum(0), hid.T @ d, np.array([d.sum()], np.float32)]

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 4, epochs: int = EPOCHS) -> Network:
        rng, state = np.random.default_rng(seed), {}
        epochs = min(30, max(epochs, epochs * 1500 // max(1, len(texts))))  # a small sample is read more often
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                rate = RATE * (0.3 if epoch >= epochs * 2 // 3 else 1)
                common.adam(self.params(), self.gradients([texts[k] for k in some], y[some]), state, rate)
                self.filters *= 1 - rate * DECAY
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        data, start, length, doc = chunks(texts)
        return 1 / (1 + np.exp(-np.clip(self.head(self.pooled(data, start, length), doc, len(texts))[0], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A function from texts to probabilities."""
    low, high = common.training_rows(docs, labels, "quality", FOLDS, sample)
    if not low or not high:
        share = len(high) / (len(low) + len(high)) if low or high else 0.5
        return lambda texts: np.full(len(texts), share)
    net = Network().fit(low + high, np.array([0.0] * len(low) + [1.0] * len(high)))
    return net.score


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return common.score_texts(docs, fit(docs, common.table(spark, sf_dir, "labels")), FOLDS, 0.3)
