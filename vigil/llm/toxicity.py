"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is its embedding (words of the training rows' vocabulary only) plus the mean of the hashed embeddings of its byte 4-grams with both ends marked. Windows of
WINDOW words, STRIDE apart, cover the whole text and overlap by half, so that a passage of up to STRIDE words lies whole in one; each is read both ways, pooled by attention and scored; a
document scores as its highest window. Trained in numpy on at most SAMPLE documents of each class, the label belonging to the
document: each window takes the gradient in the share of its softmax among the document's windows.

Defined results: null and wordless texts score 0; without rows of both classes every score is 0; repeated rows score alike; no
rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common
from .common import Words

SAMPLE = 1000
WINDOW, STRIDE = 32, 16
D, H = 16, 8
VOCABULARY, LEAST_DF, GRAMS = 8192, 6, 1 << 14
EPOCHS, BATCH, RATE, DECAY, DROP = 5, 16, 0.02, 0.02, 0.2
FOLDS = 5


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, x)
    np.exp(np.clip(x, -60, 60, out=x), x)
    x += 1
    return np.reciprocal(x, x)


class Inputs:
    """Distinct words of several texts with their features, and the windows of each text."""

    def __init__(self, texts: list[str]):
        w = Words(texts, common.NOT_ALNUM)
        h = w.hashes()
        _, at, self.token = np.unique(h, return_index=True, return_inverse=True)
        self.hash = h[at]
        self.hidden = np.zeros(len(at), bool)
        data = np.where(common.NOT_ALNUM[w.data], 32, w.data).astype(np.uint32)
        code = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
        code *= np.uint32(0x9E3779B1)
        code ^= code >> 15
        code *= np.uint32(0x85EBCA6B)
        code >>= 32 - 14
        length = w.end[at] - w.start[at]
        n = np.maximum(length - 1, 1)  # 4-grams from the byte before the word to the one after it; a single letter has its own
        self.first = np.cumsum(n) - n
        pos = np.arange(n.sum()) - np.repeat(self.first - (w.start[at] - 1), n)
        self.gram = code[np.minimum(pos, len(code) - 1)]
        self.n = n
        size = np.diff(w.bounds)
        start, self.doc = [], []
        for d, (a, k) in enumerate(zip(w.bounds, size, strict=False)):
            if k:
                own = range(0, k - WINDOW, STRIDE) if k > WINDOW else ()
                start += [a + s for s in own] + [a + max(0, k - WINDOW)]
                self.doc += [d] * (len(own) + 1)
        self.doc = np.array(self.doc, np.int64)
        start = np.array(start, np.int64)
        index = start[:, None] + np.arange(WINDOW)
        self.mask = index < w.bounds[1:][self.doc][:, None] if len(start) else np.zeros((0, WINDOW), bool)
        self.windows = self.token[np.minimum(index, max(0, len(self.token) - 1))] if len(start) else np.zeros((0, WINDOW), np.int64)


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *s, k=0.1: rng.normal(0, k, s).astype(np.float32)
        self.vocabulary = np.zeros(0, np.uint64)
        self.words, self.grams = f(VOCABULARY + 1, D, k=0.3), f(GRAMS, D, k=0.3)
        self.wx, self.bx = f(D, 6 * H, k=0.3), np.zeros(6 * H, np.float32)
        self.uf, self.ub = f(H, 3 * H, k=0.3), f(H, 3 * H, k=0.3)
        self.att, self.out, self.bias = f(2 * H, k=0.3), f(2 * H, k=0.3), np.full(1, -1.0, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.words, self.grams, self.wx, self.bx, self.uf, self.ub, self.att, self.out, self.bias]

    def learn_words(self, texts: list[str]) -> None:
        """The vocabulary: hashes of the words in most texts; ties by hash."""
        seen = [np.unique(Words([t], common.NOT_ALNUM).hashes()) for t in texts]
        words, df = np.unique(np.concatenate(seen), return_counts=True)
        words, df = words[df >= LEAST_DF], df[df >= LEAST_DF]
        self.vocabulary = np.sort(words[np.argsort(-df, kind="stable")[:VOCABULARY]])

    def known(self, x: Inputs) -> np.ndarray:
        """Rows of the word embedding; the last is every other word's."""
        if not len(self.vocabulary):
            return np.full(len(x.hash), VOCABULARY)
        at = np.minimum(np.searchsorted(self.vocabulary, x.hash), len(self.vocabulary) - 1)
        return np.where((self.vocabulary[at] == x.hash) & ~x.hidden, at, VOCABULARY)

    def embed(self, x: Inputs) -> tuple[np.ndarray, np.ndarray]:
        e = self.words[self.known(x)]
        if len(x.first):
            e = e + np.add.reduceat(self.grams[x.gram], x.first) / x.n[:, None].astype(np.float32)
        return e, e @ self.wx + self.bx

    def _pass(self, g, windows, mask, u, steps, keep):
        h = np.zeros((len(windows), H), np.float32)
        states = np.empty((WINDOW, len(windows), H), np.float32)
        saved = {}
        full = mask.all()
        for t in steps:
            x = g[windows[:, t]]
            a = h @ u
            zr = sigmoid(x[:, : 2 * H] + a[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = x[:, 2 * H :] + r * a[:, 2 * H :]
            n *= 2
            n = sigmoid(n)
            n *= 2
            n -= 1
            new = n + z * (h - n)
            if not full:
                new = np.where(mask[:, t : t + 1], new, h)
            if keep:
                saved[t] = (h, z, r, n, a[:, 2 * H :])
            h = states[t] = new
        return states, saved

    def forward(self, g, windows, mask, keep=False):
        sf, kf = self._pass(np.ascontiguousarray(g[:, : 3 * H]), windows, mask, self.uf, range(WINDOW), keep)
        sb, kb = self._pass(np.ascontiguousarray(g[:, 3 * H :]), windows, mask, self.ub, range(WINDOW - 1, -1, -1), keep)
        s = sf @ self.att[:H] + sb @ self.att[H:]
        s = np.where(mask.T, s, -1e9)
        s = np.exp(s - s.max(0))
        s /= s.sum(0)
        pooled = np.concatenate((np.einsum("tw,twh->wh", s, sf), np.einsum("tw,twh->wh", s, sb)), 1)
        return pooled @ self.out + self.bias[0], (sf, sb, kf, kb, s, pooled)

    def gradients(self, x: Inputs, y: np.ndarray, focus: float) -> list[np.ndarray]:
        """Of the logistic loss of the windows, each in its share of its document; y: the documents' labels."""
        e, g = self.embed(x)
        logit, (sf, sb, kf, kb, s, pooled) = self.forward(g, x.windows, x.mask, True)
        top = np.full(len(y), -1e9)
        np.maximum.at(top, x.doc, logit)
        share = np.exp(focus * (logit - top[x.doc]))
        share /= np.bincount(x.doc, share, len(y))[x.doc]
        d = (share * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[x.doc]) / len(y)).astype(np.float32)
        dout, dbias = pooled.T @ d, np.array([d.sum()], np.float32)
        dp = d[:, None] * self.out
        ds = np.einsum("twh,wh->tw", sf, dp[:, :H]) + np.einsum("twh,wh->tw", sb, dp[:, H:])
        ds = s * (ds - (s * ds).sum(0))
        datt = np.concatenate((np.einsum("tw,twh->h", ds, sf), np.einsum("tw,twh->h", ds, sb)))
        each = np.zeros((*x.windows.shape, 6 * H), g.dtype)
        du = []
        for lo, u, saved, steps, half in ((0, self.uf, kf, range(WINDOW - 1, -1, -1), 0), (3 * H, self.ub, kb, range(WINDOW), H)):
            dh = np.zeros((len(d), H), np.float32)
            grad = np.zeros_like(u)
            for t in steps:
                h, z, r, n, an = saved[t]
                dh = dh + s[t][:, None] * dp[:, half : half + H] + ds[t][:, None] * self.att[half : half + H]
                m = x.mask[:, t : t + 1]
                dnew = np.where(m, dh, 0)
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (h - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                da = np.concatenate((dz, dr, dn * r), 1)
                grad += h.T @ da
                each[:, t, lo : lo + 3 * H] = np.concatenate((dz, dr, dn), 1)
                dh = np.where(m, dnew * z + da @ u.T, dh)
            du.append(grad)
        flat = x.windows.ravel()
        order = np.argsort(flat, kind="stable")
        tokens, first = np.unique(flat[order], return_index=True)
        dg = np.zeros_like(g)
        dg[tokens] = np.add.reduceat(each.reshape(len(flat), -1)[order], first)
        de = dg @ self.wx.T
        dwords, dgrams = np.zeros_like(self.words), np.zeros_like(self.grams)
        np.add.at(dwords, self.known(x), de)
        np.add.at(dgrams, x.gram, np.repeat(de / x.n[:, None].astype(np.float32), x.n, 0))
        return [dwords, dgrams, e.T @ dg, dg.sum(0), *du, datt.astype(np.float32), dout, dbias]

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 3, epochs: int = EPOCHS) -> Network:
        rng, state = np.random.default_rng(seed), {}
        self.learn_words(texts)
        epochs = min(24, max(epochs, epochs * 1200 // max(1, len(texts))))  # a small sample is read more often
        order = rng.permutation(len(texts))
        batches = []
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            x = Inputs([texts[k] for k in some])
            if len(x.windows):
                batches.append((x, y[some]))
        for epoch in range(epochs):
            for i in rng.permutation(len(batches)):
                x, own = batches[i]
                x.hidden = rng.random(len(x.hash)) < DROP  # words read by their characters alone
                grads = self.gradients(x, own, 1.0 if epoch < epochs // 2 else 3.0)
                rate = RATE * (0.3 if epoch >= epochs * 2 // 3 else 1)
                common.adam(self.params(), grads, state, rate)
                self.words *= 1 - rate * DECAY
                self.grams *= 1 - rate * DECAY
        return self

    def score(self, texts: list[str], block: int = 1024) -> np.ndarray:
        x = Inputs(texts)
        best = np.full(len(texts), -np.inf)
        if len(x.windows):
            g = self.embed(x)[1]
            full = x.mask.all(1)
            for rows in (np.flatnonzero(full), np.flatnonzero(~full)):
                for i in range(0, len(rows), block):
                    own = rows[i : i + block]
                    np.maximum.at(best, x.doc[own], self.forward(g, x.windows[own], x.mask[own])[0])
        return 1 / (1 + np.exp(-np.clip(best, -30, 30))) * np.isfinite(best)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    clean, toxic = common.training_rows(docs, labels, "toxic", FOLDS, sample)
    if not clean or not toxic:
        return None
    return Network().fit(clean + toxic, np.array([0.0] * len(clean) + [1.0] * len(toxic)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    net = fit(docs, common.table(spark, sf_dir, "labels"))
    score = net.score if net else lambda texts: np.zeros(len(texts))
    return common.score_texts(docs, score, FOLDS, 0.5)
