"""PII: candidate gradient boosting over spans.

Base detectors (email, ip, card, phone) give spans that always stay. High-recall generators propose further, overlapping
spans (secrets, account numbers, obfuscated or national forms); boosted trees on format and context features score
them, Platt scaling calibrates the scores and a threshold for each kind, set for precision on synthetic held-out rows, selects. Of
overlapping selected spans the likeliest stays, of those of one kind that lie within each other the longest; none that overlaps a base span is added. The trees are trained
here, on a fixed synthetic set of written-out formats among invented words: no document takes part.

Defined results: null text counts as empty; no spans give empty strings and the checksum of the empty text; offsets are code points, end
exclusive; repeated rows give repeated results; no rows give no rows; other columns are ignored. All patterns
run in linear time on very long texts.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:  # around each @, as the pattern would match from the left
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_AT, _DOT = r"(?: ?[\[(](?:at|AT|@)[\])] ?| at | AT )", r"(?: ?[\[(](?:dot|DOT|\.)[\])] ?| dot | DOT )"
# High-recall generators: (kind, a sign of which one must be present, pattern). Where there is a group, it is the span.
GENERATORS = [
    ("email", "@", re.compile(r"(?<![\w.+-])[\w.+-]{1,64} ?@ ?[\w-]{1,63}(?:\.[\w-]{1,63}){1,4}")),
    ("email", "dot DOT [.] (.) [.) (.]", re.compile(rf"(?<![\w.+-])[\w.+-]{{1,64}}{_AT}[\w-]{{1,63}}(?:{_DOT}[\w-]{{2,63}}){{1,4}}")),
    ("email", "at) at] AT) AT]", re.compile(r"(?<![\w.+-])[\w.+-]{1,64} ?[\[(](?:at|AT)[\])] ?[\w-]{1,63}(?:\.[\w-]{2,63}){1,4}")),
    ("ip", ":", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("ip", "::", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")),
    ("card", "", re.compile(r"(?<![0-9])[0-9](?:[\x20./ -]{0,2}[0-9]){12,18}(?![0-9])")),
    ("card", "", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("phone", "", re.compile(r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])")),
    ("phone", "+", re.compile(r"\+[0-9]{1,3} ?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])")),
    ("phone", "00", re.compile(r"(?<![0-9])00[1-9][0-9 ()./-]{8,16}[0-9](?![0-9])")),
    ("phone", "", re.compile(r"(?<![0-9])0[1-9](?:[\x20./-][0-9]{2}){4}(?![0-9])")),
    ("phone", "", re.compile(r"(?<![0-9])\(?0[1-9][0-9]{1,4}\)?[\x20]?[\x20/-][\x20]?[0-9]{5,8}(?![0-9])")),
    ("phone", "+", re.compile(r"\+[0-9]{1,3}(?:[\x20./-]?\(?[0-9]{1,4}\)?){3,6}(?![0-9])")),
    ("ssn", "-", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("secret", "= :", re.compile(r"(?i)(?:passwor[dt]|passwd|pwd|passphrase|kennwort|mot de passe|contrase[nñ]a|token|secret|api[_-]?key|access[_-]?key|\bkey)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]{6,}+)")),
    ("secret", "", re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])")),
    ("secret", "eyJ", re.compile(r"(?<![\w-])eyJ[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}+(?![\w-])")),
    ("secret", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]{0,30}KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,30}KEY-----)?")),
    ("secret", "AKIA ASIA ghp_ sk- xox", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{16,}+")),
]
_WORDS = ("passwor", "pwd", "passphrase", "kennwort", "passe", "contrase", "token", "secret", "key", "phone", "tel", "call", "card", "ssn", "iban", "mail", "version", "commit", "isbn", "order", "id")


def candidates(text: str) -> list[Span]:
    found = set()
    digit = _DIGIT.search(text) is not None
    for kind, signs, pattern in GENERATORS:
        if any(x in text for x in signs.split()) if signs else digit:
            found |= {(*m.span(m.re.groups), kind) for m in pattern.finditer(text)}
    return sorted(found)


def features(text: str, span: Span) -> list[float]:
    s, e, kind = span
    x = text[s:e]
    n = len(x)
    digits = _digits(x)
    counts = np.array([x.count(c) for c in set(x)]) / n
    before, after = text[max(0, s - 24) : s], text[e : e + 2]
    low = before.lower()
    return [
        KINDS.index(kind),
        n,
        len(digits),
        len(digits) / n,
        sum(c.isupper() for c in x) / n,
        sum(c.islower() for c in x) / n,
        sum(c in "0123456789abcdefABCDEF" for c in x) / n,
        float(-(counts * np.log2(counts)).sum()),
        len(set(x)),
        sum(1 for a, b in zip(x, x[1:], strict=False) if a.isdigit() != b.isdigit()),
        x.count(" "),
        x.count("."),
        x.count("-"),
        x.count("/"),
        x.count(":"),
        float("@" in x or " at " in x.lower() or "(at)" in x.lower() or "[at]" in x.lower()),
        float(luhn(digits)) if digits else 0.0,
        float(iban_ok(x)) if kind == "iban" else 0.0,
        float(before[-1:].isalnum()),
        float(before.rstrip(" \"'")[-1:] in ("=", ":") and bool(before)),
        float(after[:1].isalnum()),
        float(before.rstrip()[-1:] in "$€£" and bool(before.strip())),
        float(before.rstrip(" ().-/")[-1:].isdigit()),  # part of a longer run of numbers
        float(before.rstrip(" (")[-1:] == "+"),
        float(text[e : e + 3].lstrip(" ().-/")[:1].isdigit()),
        float(x.startswith("eyJ") and x.count(".") == 2),
        float(x.startswith("-----BEGIN")),
        float("::" in x),
        float(x[:1] == "0" or x[:2] == "(0"),
        *(float(w in low) for w in _WORDS),
    ]


def iban_ok(x: str) -> bool:
    x = x.replace(" ", "")
    return x.isascii() and x.isalnum() and 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


class Trees:
    """Boosted regression trees on binned features, logistic loss."""

    def __init__(self, trees: int = 90, depth: int = 4, rate: float = 0.2, bins: int = 24, least: int = 8):
        self.n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        self.first = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        f, self.trees = np.full(len(y), self.first), []
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self._apply(tree, b)
        return self

    def _grow(self, b, g, h, rows, depth):
        leaf = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
        best = (1e-6, None, None)
        if depth:
            total, weight = g[rows].sum(), h[rows].sum()
            for j in range(b.shape[1]):
                gs = np.bincount(b[rows, j], g[rows], self.bins).cumsum()[:-1]
                hs = np.bincount(b[rows, j], h[rows], self.bins).cumsum()[:-1]
                ns = np.bincount(b[rows, j], minlength=self.bins).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (total - gs) ** 2 / (weight - hs + 1) - total**2 / (weight + 1)
                gain[(ns < self.least) | (len(rows) - ns < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[1] is None:
            return leaf
        left = b[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1)

    def _apply(self, tree, b):
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        j, k, left, right = tree
        return np.where(b[:, j] <= k, self._apply(left, b), self._apply(right, b))

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        return self.first + sum(self._apply(t, b) for t in self.trees)


def _synthetic(rng: random.Random, n: int) -> list[tuple[str, list[Span]]]:
    """Texts of invented words with entities (wanted) and look-alikes (not wanted)."""
    hexes, alnum, upper = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    num = lambda k: pick("0123456789", k)
    parts = ["er", "on", "the", "ti", "an", "is", "ea", "ou", "re", "st", "lo", "ka", "mi", "schaft", "que", "eux", "ado"]
    word = lambda k=3: "".join(rng.choice(parts) for _ in range(rng.randint(1, k)))

    def card() -> str:
        d = num(15)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def iban() -> str:
        c, rest = rng.choice(["DE", "FR", "ES", "GB"]), num(rng.choice([16, 18, 20]))
        return next(x for k in range(98) if iban_ok(x := f"{c}{k:02d}{rest}"))

    def said() -> str:
        return rng.choice(["password", "passwort", "Passwort", "pwd", "passphrase", "Password", "kennwort", "mot de passe", "secret"]) + rng.choice(["=", ": ", " = ", " : "])

    def wanted() -> tuple[str, str, str, str]:
        k = rng.randrange(30)
        sep = rng.choice([".", "/", " ", "-"])
        return [
            lambda: ("password=", pick(hexes, rng.randint(8, 24)), "", "secret"),
            lambda: ('token = "', pick(hexes, rng.choice([32, 40, 64])), '"', "secret"),
            lambda: (rng.choice(["api_key: ", "secret=", "pwd: ", "key="]), pick(alnum, rng.randint(8, 40)), "", "secret"),
            lambda: ("", "AKIA" + pick(upper, 16), "", "secret"),
            lambda: ("", rng.choice(["ghp_", "sk-", "xoxb-"]) + pick(alnum, rng.randint(24, 40)), "", "secret"),
            lambda: ("", f"{word()} at {word()} dot com", "", "email"),
            lambda: ("", f"{word()}{rng.choice(['[at]', '(at)', ' [at] '])}{word()}{rng.choice(['[dot]', '.', ' (dot) '])}org", "", "email"),
            lambda: ("", f"({num(3)}) {num(3)}-{num(4)}", "", "phone"),
            lambda: (rng.choice(["", "tel ", "call "]), f"{num(3)}{sep[:1]}{num(3)}{sep[:1]}{num(4)}", "", "phone"),
            lambda: ("", f"00{rng.randint(1, 9)}{num(1)} {num(3)} {num(3)} {num(4)}", "", "phone"),
            lambda: ("", f"{num(3)}-{num(2)}-{num(4)}", "", "ssn"),
            lambda: ("", iban(), "", "iban"),
            lambda: ("", card(), "", "card"),
            lambda: (f"{num(3)}-{num(4)} ", card(), "", "card"),
            lambda: ("", ":".join(pick(hexes, 4) for _ in range(8)), "", "ip"),
            lambda: ("", f"{word()}.{word()}{num(2)}@{word()}.example.com", "", "email"),
            lambda: ("", f"+{rng.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", "", "phone"),
            lambda: ("", (lambda c, s: s.join((c[:4], c[4:8], c[8:12], c[12:])))(card(), rng.choice([".", "/", "  "])), "", "card"),
            lambda: (said(), rng.choice("-_.").join(word(2) for _ in range(rng.randint(3, 5))), "", "secret"),
            lambda: (said(), word(3).ljust(5, "a") + num(rng.randint(1, 4)), "", "secret"),
            lambda: (said(), word(3).title().ljust(5, "a") + rng.choice("!#$%&*?+") + num(rng.randint(0, 3)), "", "secret"),
            lambda: ("", f"eyJ{pick(alnum, rng.randint(12, 40))}.{pick(alnum + '_-', rng.randint(16, 120))}.{pick(alnum + '_-', rng.randint(20, 60))}", "", "secret"),
            lambda: ("", (lambda n: f"-----BEGIN {n}KEY-----\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(rng.randint(1, 4))) + f"\n-----END {n}KEY-----")(rng.choice(["PRIVATE ", "RSA PRIVATE ", "EC PRIVATE "])), "", "secret"),
            lambda: (rng.choice(["", "tel ", "call "]), "0" + str(rng.randint(1, 9)) + "".join(f"{sep}{num(2)}" for _ in range(4)), "", "phone"),
            lambda: (rng.choice(["", "tel ", "call "]), f"0{rng.randint(1, 9)}{num(rng.randint(1, 3))}{rng.choice(['/', ' ', '-', ' / '])}{num(rng.randint(5, 8))}", "", "phone"),
            lambda: ("", f"{pick(hexes, 4)}:{pick(hexes, rng.randint(1, 4))}::{rng.choice(['', pick(hexes, rng.randint(1, 4)) + ':'])}{rng.choice('123456789')}{pick(hexes, rng.randint(0, 3))}", "", "ip"),
            lambda: (rng.choice(["token: ", "password=", "secret = "]), ".".join(pick(alnum, rng.randint(20, 400)) for _ in range(3)), "", "secret"),
            lambda: ("", rng.choice("xa0") * rng.choice([0, 0, 20, 300]) + pick(alnum, rng.randint(100, 900)), "", "secret"),
            lambda: ("", rng.choice(["sk-", "ghp_"]) + pick(alnum, rng.randint(40, 900)), "", "secret"),
            lambda: ("", f"fe80::{pick(hexes, 4)}:{rng.choice('0123456789')}{pick(hexes, 3)}", "", "ip"),
        ][k]()

    def other() -> str:
        return [
            lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
            lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
            lambda: f"${rng.randint(1, 999)},{num(3)}.{num(2)}",
            lambda: f"order {num(rng.randint(5, 12))}",
            lambda: f"id {num(rng.randint(13, 18))}",
            lambda: "".join(word(2) for _ in range(8)).upper(),
            lambda: "".join(word(2) for _ in range(8)),
            lambda: f"commit {pick(hexes, 40)}",
            lambda: f"ISBN {num(3)}-{num(1)}-{num(5)}-{num(3)}-{num(1)}",
            lambda: f"{word()} at {word()} {word()}",
            lambda: f"key: {word()} {word()}",
            lambda: f"the token = {''.join(word(2) for _ in range(3))} of",
            lambda: f"{rng.randint(0, 23):02d}:{num(2)}:{num(2)}:{num(2)}",
            lambda: f"{''.join(word(2) for _ in range(6))}-{word()}-{word()}{rng.randint(1, 9)}",
            lambda: f"{rng.randint(1, 200)} {num(3)} {num(3)} units",
            lambda: f"{num(3)}/{num(4)}/{num(4)}x{num(2)}",
            lambda: f"{rng.choice(['abc', 'dead', 'fab', 'std', 'face'])}::{rng.choice(['cafe', 'bad', 'add', 'feed', 'map'])}",
            lambda: f"order 0{num(2)}/{num(6)}",
            lambda: f"{rng.choice(['password', 'token', 'the key', 'passwort'])} {word()} {word()}",
            lambda: f"0{rng.randint(1, 9)}.{num(2)}.{rng.randint(1990, 2030)}",
            lambda: rng.choice(["AB", "XK", "NO"]) + num(2) + " " + word().upper().ljust(4, "A")[:4] + " " + num(4),
        ][rng.randrange(21)]()

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(1, 6))) + " ", []
        for _ in range(3):
            if rng.random() < 0.5:
                pre, body, post, kind = wanted()
                spans.append((len(text) + len(pre), len(text) + len(pre) + len(body), kind))
                text += pre + body + post
            else:
                text += other()
            text += rng.choice([" ", ", ", ". "]) + " ".join(word() for _ in range(rng.randint(1, 5))) + " "
        out.append((text, spans))
    return out


def whole(rows: list[int], spans: list[Span]) -> list[int]:
    """The rows whose span is no part of a longer one of its kind among them."""
    out, reach = [], {}
    for i in sorted(rows, key=lambda i: (spans[i][0], -spans[i][1])):
        _, end, kind = spans[i]
        if end > reach.get(kind, -1):
            reach[kind] = end
            out.append(i)
    return out


class Detector:
    def __init__(self, trees: Trees, slope: float, shift: float, thresholds: dict[str, float]):
        self.trees, self.slope, self.shift, self.thresholds = trees, slope, shift, thresholds

    def score(self, text: str, spans: list[Span]) -> np.ndarray:
        m = self.trees.margin(np.array([features(text, s) for s in spans]))
        return 1 / (1 + np.exp(-(self.slope * m + self.shift)))

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans and all spans, each in order of start, then kind."""
        if not text:
            return [], []
        base = base_spans(text)
        taken = bytearray(len(text))  # a mark for each sign of a span
        for start, end, _ in base:
            taken[start:end] = b"\1" * (end - start)
        free = [c for c in candidates(text) if taken.find(1, c[0], c[1]) < 0]
        added: list[Span] = []
        if free:
            p = self.score(text, free)
            good = whole([i for i in range(len(free)) if p[i] >= self.thresholds[free[i][2]]], free)
            for i in sorted(good, key=lambda i: (-p[i], free[i])):
                start, end, kind = free[i]
                if taken.find(1, start, end) < 0:
                    added.append(free[i])
                    taken[start:end] = b"\1" * (end - start)
        return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@lru_cache(maxsize=1)
def detector(seed: int = 11) -> Detector:
    rng = random.Random(seed)

    def rows(n):
        x, y, kinds = [], [], []
        for text, spans in _synthetic(rng, n):
            for c in candidates(text):
                same = any(k == c[2] and abs(s - c[0]) <= 2 and abs(e - c[1]) <= 2 for s, e, k in spans)
                if not same and any(k == c[2] and s <= c[0] and c[1] <= e for s, e, k in spans):
                    continue  # a part of what is wanted is neither: the longest of nested spans stays
                x.append(features(text, c))
                y.append(float(same))
                kinds.append(c[2])
        return np.array(x), np.array(y), np.array(kinds)

    x, y, _ = rows(4000)
    trees = Trees().fit(x, y)
    x, y, kinds = rows(2000)
    m = trees.margin(x)
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Platt scaling by Newton steps
        p = 1 / (1 + np.exp(-(slope * m + shift)))
        w = p * (1 - p) + 1e-6
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, [((p - y) * m).sum(), (p - y).sum()])
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-(slope * m + shift)))
    thresholds = {}
    for k in KINDS:
        own = kinds == k
        good = [t for t in np.linspace(0.5, 0.95, 31) if own.any() and (p[own] >= t).any() and y[own][p[own] >= t].mean() >= 0.97]
        thresholds[k] = float(good[0]) if good else 0.95
    return Detector(trees, float(slope), float(shift), thresholds)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): lists of kind:start:end."""
    common.small_batches(docs.sparkSession)
    model = detector()

    def run(batches):
        for pdf in batches:
            found = [model.spans(t) for t in pdf["text"]]
            show = lambda spans: [f"{k}:{s}:{e}" for s, e, k in spans]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "base": [show(b) for b, _ in found], "spans": [show(a) for _, a in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, base array<string>, spans array<string>")


def redact(text: str) -> str:
    """The text with each span replaced by its kind."""
    out, at = [], 0
    for s, e, k in detector().spans(text)[1]:
        if e > at:
            out += [text[at : max(at, s)], f"<{k}>"]
            at = e
    return "".join(out) + text[at:]


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find_pii(common.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:4]),
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
        (F.size("spans") > 0).alias("personal"),
    )


