"""Personal data: validated base patterns, and gradient-boosted candidates beyond them.

High-recall generators propose spans that may overlap; boosted trees judge each by its format and its context; a
threshold calibrated per kind selects what is redacted. The trees are trained on the driver from spans that templates
make with a fixed seed, so they need no corpus, are the same at every size, and travel as one small broadcast value.
The base patterns' spans are always kept; a candidate that overlaps one of them is not reported again.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only candidates have, after the base kinds in the order of spans.
MORE_KINDS = ("ssn", "iban", "contact")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only: a later start in the same run meets the same end.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@+]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @: the local part back to the last match's end, the domain forward; linear for any text."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base pattern that pass its test, by kind, then start."""
    if not _ANY.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_DIGIT = re.compile(r"[0-9]")
_SPELT_AT = re.compile(r"[(\[]at[)\]]")

#: What proposes candidates: (kind, mark, pattern). They overlap each other and the base patterns, and take far too much.
GENERATORS = (
    ("ssn", "digit", re.compile(r"(?<![0-9])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9])")),
    ("iban", "digit", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")),
    ("contact", "digit", re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,4}\)?[\x20./-][0-9]{2,4}[\x20./-][0-9]{3,4}(?![0-9])")),
    ("contact", "digit", re.compile(r"(?<![0-9A-Za-z])0[0-9]{2,4}[\x20/-]?[0-9]{4,8}(?![0-9])")),
    ("contact", "at", re.compile(r"[A-Za-z0-9._-]{2,40}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{2,40}\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,10}")),
)
_CUES = re.compile(r"ssn|social|iban|account|konto|compte|cuenta|phone|tel|call|mobile|fax|mail|contact|reach|identity|passport|insurance", re.IGNORECASE)
_ANTI = re.compile(r"isbn|order|invoice|version|page|serial|total|price|sum|date|part no|model|figure|eq\.", re.IGNORECASE)
CONTEXT = 32


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format (lengths, classes, separators, checks) and context (cue words before and after, neighbouring digits)."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = _digits(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    seps = {c for c in span if not c.isalnum()}
    cue, anti = _CUES.search(before), _ANTI.search(before)
    return [
        float((*MORE_KINDS, "").index(kind)), float(len(span)), float(len(digits)), float(sum(c.isalpha() for c in span)), float(len(groups)), float(max(groups, default=0)),
        float(len(seps)), float("-" in seps), float("." in seps), float("/" in seps), float(" " in seps), float("(" in span),
        float(len(set(digits))), float(luhn(digits)) if digits else 0.0, float(digits[:1] == "0"), float(digits[:3] in ("000", "666") or digits[:1] == "9"),
        float(_mod97(span)), float(cue is not None), float(len(before) - cue.end()) if cue else 99.0, float(_CUES.search(after) is not None),
        float(anti is not None), float(any("0" <= c <= "9" for c in before[-3:] + after[:3])), float(before[-1:] in ("$", "€", "#")), float(after[:1] in ("%", "€", "$")),
    ]


def _mod97(span: str) -> bool:
    held = span.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", held):
        return False
    return int("".join(str(int(c, 36)) for c in held[4:] + held[:4])) % 97 == 1


class Boosted:
    """Gradient-boosted trees for log loss: exact greedy splits over quantile cuts, shrinkage, calibrated by Platt's method."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, cuts: int = 24) -> None:
        self.rounds, self.depth, self.rate, self.cuts = rounds, depth, rate, cuts
        self.trees: list = []
        self.base, self.slope, self.shift = 0.0, 1.0, 0.0

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        weight = float(g.sum() / (h.sum() + 1.0))
        if depth == 0 or len(g) < 20:
            return weight
        top, best = g.sum() ** 2 / (h.sum() + 1.0), (1e-3, None, None)
        for j in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 2)[1:-1], method="nearest")):
                left = x[:, j] <= cut
                if 5 <= left.sum() <= len(g) - 5:
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - top
                    if gain > best[0]:
                        best = (gain, j, float(cut))
        if best[1] is None:
            return weight
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1))

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        return np.where(left, self._walk(tree[2], x), self._walk(tree[3], x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            self.trees.append(self._grow(x, y - p, p * (1 - p), self.depth))
            raw += self.rate * self._walk(self.trees[-1], x)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        m = self.margin(x)
        for _ in range(200):
            p = 1 / (1 + np.exp(-(self.slope * m + self.shift)))
            self.slope += 0.05 * float(((y - p) * m).mean())
            self.shift += 0.05 * float((y - p).mean())

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


SAMPLES = 4000
PRECISION = 0.98
SEED = 11


def _made(rng: random.Random) -> tuple[str, str, int, int, int]:
    """A text with one candidate at a known place, and whether it is personal."""
    kind, personal = rng.choice(MORE_KINDS), rng.random() < 0.5
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    sep = rng.choice("- ")
    if kind == "ssn":
        span = f"{rng.randint(100, 665)}{sep}{rng.randint(10, 99)}{sep}{rng.randint(1000, 9999)}" if personal else f"{rng.choice([d(3), '000', '9' + d(2)])}{sep}{d(2)}{sep}{d(4)}"
    elif kind == "iban":
        body = d(rng.choice([14, 18, 20]))
        country = rng.choice(["DE", "FR", "ES", "GB", "IT"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        span = f"{country}{check if personal else (check + rng.randint(1, 90)) % 97:02d}{body}"
        span = " ".join(span[i : i + 4] for i in range(0, len(span), 4)) if rng.random() < 0.5 else span
    else:
        shapes = [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)}/{d(6)}", f"{rng.choice(['ana', 'j.doe', 'info'])}(at){rng.choice(['mail', 'firm'])}.com"]
        span = rng.choice(shapes) if personal else rng.choice([f"{d(3)}.{d(2)}.{d(4)}", f"{d(4)}/{d(2)}/{d(4)}", f"0{d(6)}", f"{d(2)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(4)}"])
    words = ["the", "of", "and", "der", "les", "que", "was", "then", "in", "une"]
    filler = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
    good = ["SSN", "social security", "IBAN", "account", "phone", "tel.", "call", "contact", "mobile"]
    poor = ["order", "ISBN", "invoice", "version", "serial", "total", "page", "date"]
    cue = rng.choice(good if personal else poor) if rng.random() < (0.75 if personal else 0.5) else ""
    head = f"{filler()} {cue}{rng.choice([': ', ' ', ' no. '])}"
    return f"{head}{span} {filler()}", kind, len(head), len(head) + len(span), int(personal)


@functools.cache
def trained(samples: int = SAMPLES) -> tuple[Boosted, dict[str, float]]:
    """The trees and each kind's threshold: the lowest of PRECISION on the calibration part, never under one half."""
    rng = random.Random(SEED)
    rows = [_made(rng) for _ in range(samples)]
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows])
    y = np.array([p for *_, p in rows], float)
    cut = samples * 2 // 3
    model = Boosted().fit(x[:cut], y[:cut])
    model.calibrate(x[cut:], y[cut:])
    p, limits = model.probability(x[cut:]), {}
    for i, kind in enumerate(MORE_KINDS):
        own = x[cut:, 0] == i
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[cut:][own][order]) / np.arange(1, own.sum() + 1)
        good = np.nonzero(right >= PRECISION)[0]
        limits[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.01
    return model, limits


def candidates(text: str) -> list[tuple[str, int, int]]:
    """All proposals; a generator is only asked where its mark (a digit, a spelt-out at sign) is in the text."""
    marks = {"digit": _DIGIT.search(text), "at": _SPELT_AT.search(text)}
    return sorted({(kind, *m.span()) for kind, mark, pattern in GENERATORS if marks[mark] for m in pattern.finditer(text)}, key=lambda s: (s[1], s[2], s[0]))


def _covered(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def more_spans(text: str, base: list[tuple[str, int, int]], model: Boosted, limits: dict[str, float]) -> list[tuple[str, int, int]]:
    """The candidates over their kind's threshold that overlap no base span and no likelier candidate."""
    found = candidates(text)
    if not found:
        return []
    odds = model.probability(np.array([features(text, *s) for s in found]))
    taken: list[tuple[str, int, int]] = []
    # What is covered already, as stretches that don't overlap: only the last that begins before a span ends can meet it.
    starts, ends = _covered(base)
    over = [s for p, s in sorted(zip(odds, found, strict=True), key=lambda z: (-z[0], z[1][1])) if p >= limits[s[0]]]
    for kind, a, b in over:
        i = bisect.bisect_left(starts, b)
        if not i or ends[i - 1] <= a:
            starts.insert(i, a)
            ends.insert(i, b)
            taken.append((kind, a, b))
    order = {k: n for n, k in enumerate(MORE_KINDS)}
    return sorted(taken, key=lambda s: (order[s[0]], s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def find(df: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep``, counts of the base kinds, ``base_sha256``, ``spans`` (base, then added) and ``redacted``.

    Offsets are code points, ends exclusive. Null texts count as empty. Rows may repeat; other columns are ignored; an
    empty table gives no rows.
    """
    shipped = df.sparkSession.sparkContext.broadcast(trained())

    def make() -> Callable:
        def work(texts: list) -> dict:
            model, limits = shipped.value
            counts, shas, spans, clean = {k: [] for k in KINDS}, [], [], []
            for t in texts:
                t = t or ""
                base = base_spans(t)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                every = base + more_spans(t, base, model, limits)
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                clean.append(redact(t, every) if every else t)
            out = {f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}
            return out | {"base_sha256": pa.array(shas, pa.string()), "spans": pa.array(spans, pa.string()), "redacted": pa.array(clean, pa.string())}

        return work

    kind = df.schema[keep].dataType.simpleString()
    return map_texts(df, make, f"{keep} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string", text, {keep: keep})
