"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked (spaces become the piece mark, one is put in front) and cut into words, at places that no piece spans. The distinct
words of a batch are sorted, which lays them out as a depth-first walk of their trie: the forward states of a prefix are
kept while the words that share it are encoded, so each trie node is extended once.

The forward state at a node is the best arc into it. For a unigram model that is the arc of the highest sum of scores. For
a byte-pair model sums of scores don't give the model's own result, and the state is the only piece that can end the
prefix's encoding: the one that stands next to the piece before it without their being merged otherwise. Both are one pass of the same
lattice, and both give the library's ids. Pieces outside the vocabulary fall back to bytes, else to the unknown piece.

Models are read on the driver from a path (a parameter) and sent to the tasks. Nothing is trained.

Defined results: null and empty texts have no pieces and decode to the empty text; a text's own piece marks decode to spaces;
repeated rows are encoded alike; no rows give no rows; extra columns of a document pass through `encode` untouched unless they bear the
names it adds, which then are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
CACHE_WORDS = 400_000
CACHE_BYTES = 96 << 20  # of known words and their ids, about
LONGEST_KNOWN = 64  # longer words (texts without spaces) are encoded anew in each slice and not kept
CACHE_PAIRS = 400_000
SLICE = 1 << 21  # signs encoded at once: more words sorted together share more prefixes


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Encoder:
    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], unigram: bool):
        """kinds: normal, byte, unknown or other, of each id."""
        self.pieces, self.kinds, self.unigram = pieces, kinds, unigram
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        self.scores = scores
        self.longest = max(map(len, self.ids), default=1)
        self._automaton()
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.unknown = kinds.index("unknown") if "unknown" in kinds else 0
        self.floor = min((s for s, k in zip(scores, kinds, strict=True) if k == "normal"), default=0.0) - 10.0
        # words may be cut before a run of marks, and around line breaks, if no piece has one inside
        lines = not any("\n" in p for p in self.ids)
        marks = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cut = re.compile((f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+") if marks else "(?s:.+)")
        raw = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else b"" for p, k in zip(pieces, kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.clear()

    def _automaton(self) -> None:
        """A trie of the pieces with failure links: in each state the pieces of two signs or more that may end here are known, the longest first."""
        self.steps: list[dict[str, int] | None] = [None]
        self.fails, self.ends = [0], [()]
        for p in self.ids:
            at = 0
            for c in p:
                step = self.steps[at]
                if step is None:
                    step = self.steps[at] = {}
                at = step.get(c) or step.setdefault(c, len(self.steps))
                if at == len(self.steps):
                    self.steps.append(None)
                    self.fails.append(0)
                    self.ends.append(())
            if len(p) > 1:
                self.ends[at] = (p,)
        row = list((self.steps[0] or {}).values())
        while row:  # by depth: what a state fails to is less deep
            deeper = []
            for at in row:
                self.ends[at] += self.ends[self.fails[at]]
                for c, to in (self.steps[at] or {}).items():
                    back = self.fails[at]
                    while back and c not in (self.steps[back] or ()):
                        back = self.fails[back]
                    self.fails[to] = (self.steps[back] or {}).get(c, 0)
                    deeper.append(to)
            row = deeper

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.pool_at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.held = 0

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "pool": np.zeros(0, np.int32), "pool_at": np.zeros(1, np.int64), "pairs": {}, "held": 0}

    @classmethod
    def load(cls, path: str) -> Encoder:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kind = lambda i: "unknown" if sp.is_unknown(i) else "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unused(i) else "normal"
        scores = [sp.get_score(i) for i in range(n)]
        # merges are numbered in a byte-pair model: whole scores, each one less than the one before
        whole = [s for i, s in enumerate(scores) if kind(i) == "normal"]
        return cls([sp.id_to_piece(i) for i in range(n)], scores, [kind(i) for i in range(n)], not all(s == int(s) for s in whole))

    def merged(self, text: str) -> list[str]:
        """A short string by its merges: the highest score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, left: str, right: str) -> bool:
        """Whether the two stay apart and whole when encoded together."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """words: sorted."""
        out = []
        arcs: list[str] = [""]  # the piece that ends each prefix of the present word
        best = [0.0]
        states = [0]  # of the automaton, after each prefix
        before = ""
        ids, scores, longest, pairs, stands = self.ids, self.scores, self.longest, self.pairs, self.stands
        steps, fails, ends = self.steps, self.fails, self.ends
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del arcs[shared + 1 :], best[shared + 1 :], states[shared + 1 :]
            append = arcs.append
            if self.unigram:
                for end in range(shared + 1, len(word) + 1):
                    pick = word[end - 1]
                    top = best[end - 1] + (scores[ids[pick]] if pick in ids else self.floor)
                    for start in range(max(0, end - longest), end - 1):
                        k = ids.get(word[start:end])
                        if k is not None and best[start] + scores[k] > top:
                            top, pick = best[start] + scores[k], word[start:end]
                    best.append(top)
                    append(pick)
            else:
                at, end = states[shared], shared
                for pick in word[shared:]:
                    end += 1
                    step = steps[at]
                    while at and (step is None or pick not in step):
                        at = fails[at]
                        step = steps[at]
                    at = step.get(pick, 0) if step is not None else 0
                    states.append(at)
                    for piece in ends[at]:  # the longest one comes to stand first
                        key = (arcs[end - len(piece)], piece)
                        ok = pairs.get(key)
                        if ok or ok is None and stands(*key):
                            pick = piece
                            break
                    append(pick)
            before = word
            found, end = [], len(word)
            while end:
                piece = arcs[end]
                k = ids.get(piece)
                if k is not None:
                    found.append(k)
                elif self.bytes:
                    found += [self.bytes[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))]
                else:
                    found.append(self.unknown)
                end -= len(piece)
            found.reverse()
            out.append(found)
        return out

    def words(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and where each text's begin."""
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.clear()
        words: list[str] = []
        ends = [0]
        for t in texts:
            words += self.words(t)
            ends.append(len(words))
        new = sorted(set(words).difference(self.known))
        short = [w for w in new if len(w) <= LONGEST_KNOWN]
        long = [w for w in new if len(w) > LONGEST_KNOWN] if len(short) < len(new) else []
        self._learn(short)
        self.held += 120 * len(short) + 8 * sum(map(len, short))
        pool, pool_at = self.pool, self.pool_at
        self._learn(long)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        flat, starts = gather(self.pool, self.pool_at, at)
        if long:
            for w in long:
                del self.known[w]
            self.pool, self.pool_at = pool, pool_at
        return flat, starts[ends]

    def _learn(self, new: list[str]) -> None:
        """new: sorted words, not known yet."""
        if new:
            coded = self.encode_words(new)
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            self.pool = np.concatenate((self.pool, np.array([i for c in coded for i in c], np.int32)))
            self.pool_at = np.concatenate((self.pool_at, self.pool_at[-1] + np.cumsum([len(c) for c in coded])))

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Each text's bytes; the first mark is the one put in front."""
        flat, at = gather(self.raw, self.raw_at, ids)
        data, at = flat.tobytes(), at[starts]
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(at[:-1], at[1:], strict=True)]


def gather(pool: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool's ranges of the rows one after the other, and where each begins (one more at the end)."""
    size = bounds[rows + 1] - bounds[rows]
    starts = np.concatenate(([0], np.cumsum(size)))
    return pool[np.repeat(bounds[rows] - starts[:-1], size) + np.arange(starts[-1])], starts


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Adds n_tokens, ids and round_trip (whether the ids decode to the text)."""
    common.small_batches(docs.sparkSession)
    encoder = Encoder.load(model or default_model())
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    names = {f.name for f in added}
    docs = docs.drop(*names)

    def run(batches):
        # words and pairs stay known within the task; the encoder goes with it
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in common.slices(texts, SLICE):
                own = texts[a:b]
                ids, starts = encoder.encode(own)
                back = encoder.decode(ids, starts)
                same = [x == t.replace(MARK, " ").encode("utf-8", "surrogatepass") for x, t in zip(back, own, strict=True)]
                columns = [*batch.slice(a, b - a).columns, pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds `text`, decoded from ids."""
    encoder = Encoder.load(model or default_model())

    @F.pandas_udf("string")
    def back(ids):
        import pandas as pd

        rows = [np.asarray(x if x is not None else [], np.int64) for x in ids]
        starts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        return pd.Series([x.decode("utf-8", "replace") for x in encoder.decode(flat, starts)])

    return encoded.withColumn("text", back("ids"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
