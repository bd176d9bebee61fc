"""Personal data: base patterns, and further spans that boosted trees pick from candidates.

The base kinds (email, ip, card, phone) follow fixed patterns and always stay.
Generators of high recall propose more spans, which may overlap; gradient
boosting on their format and their neighbourhood scores them, and a calibrated
threshold per kind selects. All of it is one pass over the texts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # from the first digit of a run: the same matches in linear time
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
# The generators, by kind.
GENERATORS = (
    ("phone", re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])00[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])")),
    ("id", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("email", re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64} ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}){1,4}")),
    ("mac", re.compile(r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])")),
)
#: Every pattern above needs one of these.
_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]")
# Words near a span that speak for or against it.
FOR = ("phone", "tel", "call", "mobile", "fax", "contact", "mail", "write", "ssn", "social", "iban", "account", "bank", "transfer", "device", "address")
AGAINST = ("order", "invoice", "version", "page", "item", "serial", "part", "ref", "build", "ticket", "isbn", "model", "lot", "date", "total", "score")
KINDS = ("phone", "id", "iban", "email", "mac")
NEAR = 32


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, ``@`` and a domain, in time that follows the text's length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by kind and start; matches that fail their test are dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposed spans that no base span touches; they may overlap each other."""
    covered = sorted((a, b) for _, a, b in taken)
    starts = [a for a, _ in covered]
    reach = list(accumulate((b for _, b in covered), max))  # how far the spans up to each one go
    out = []
    for kind, pattern in GENERATORS:
        for m in pattern.finditer(text):
            near = bisect_left(starts, m.end())
            if not near or reach[near - 1] <= m.start():
                out.append((kind, m.start(), m.end()))
    return list(dict.fromkeys(out))


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of a span."""
    span = text[start:end]
    before, after = text[max(0, start - NEAR) : start].lower(), text[end : end + NEAR].lower()
    digits = [c for c in span if "0" <= c <= "9"]
    signs = [c for c in span if not c.isalnum()]
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    return [
        *(float(kind == k) for k in KINDS),
        float(len(span)),
        float(len(digits)),
        float(len(signs)),
        float(len(set(signs))),
        float(len(set(digits))),
        float(max(groups, default=0)),
        float(len(groups)),
        float(sum(c.isupper() for c in span)),
        float(any(w in before for w in FOR)),
        float(any(w in before for w in AGAINST)),
        float(any(w in after for w in FOR)),
        float(span.startswith(("000", "666", "9"))),
        float(before[-1:].isalnum() or after[:1].isalnum()),
        float(before[-1:] in "#$/_=" if before else False),
    ]


@dataclass
class Boosted:
    """Trees of two levels: each splits by one feature, and each side by another."""

    base: float
    trees: list[tuple]
    slope: float
    shift: float
    thresholds: dict[str, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, t, sides in self.trees:
            for mask, (g, u, low, high) in zip((x[:, f] <= t, x[:, f] > t), sides):
                out[mask] += np.where(x[mask, g] <= u, low, high)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def _split(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int, float, float, float]:
    """The split of most gain, and the Newton steps of its sides."""
    best = (-1.0, 0, np.inf, *[float(gradient.sum() / (weight.sum() + 1.0))] * 2)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        value, g, h = x[order, f], np.cumsum(gradient[order]), np.cumsum(weight[order])
        cut = np.flatnonzero(value[:-1] < value[1:])
        if len(cut):
            gain = g[cut] ** 2 / (h[cut] + 1) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                c = cut[k]
                best = (float(gain[k]), f, float(value[c] + value[c + 1]) / 2, float(g[c] / (h[c] + 1)), float((g[-1] - g[c]) / (h[-1] - h[c] + 1)))
    return best


def boost(x: np.ndarray, good: np.ndarray, kinds: list[str], rounds: int = 60, rate: float = 0.3, precision: float = 0.95) -> Boosted:
    """Fit on three quarters of the rows; the rest calibrates the sigmoid and the threshold of each kind.

    A kind's threshold is the smallest score of 0.5 or more from which on its
    calibration rows, equal scores together, hold at least ``precision``; a kind
    without such rows gets 0.9.
    """
    from .quality import sigmoid_fit

    held = np.arange(len(x)) % 4 == 3
    a, y = x[~held], good[~held].astype(float)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    raw, trees = np.full(len(a), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = y - p, p * (1 - p)
        _, f, t, *_ = _split(a, gradient, weight)
        sides = []
        for mask in (a[:, f] <= t, a[:, f] > t):
            if mask.any():
                _, g, u, low, high = _split(a[mask], gradient[mask], weight[mask])
                sides.append((g, u, rate * low, rate * high))
                raw[mask] += np.where(a[mask, g] <= u, rate * low, rate * high)
            else:
                sides.append((0, np.inf, 0.0, 0.0))
        trees.append((f, t, sides))
    model = Boosted(base, trees, 1.0, 0.0, {})
    model.slope, model.shift = sigmoid_fit(model.raw(x[held]), good[held])
    scores, held_kinds = model.score(x[held]), np.array(kinds)[held]
    for kind in KINDS:
        mine = held_kinds == kind
        order = np.argsort(-scores[mine], kind="stable")
        falling = scores[mine][order]
        right = np.cumsum(good[held][mine][order]) / np.arange(1, mine.sum() + 1) >= precision
        right &= np.append(falling[1:] < falling[:-1], True)[: len(falling)]
        model.thresholds[kind] = max(0.5, float(falling[np.flatnonzero(right)[-1]])) if right.any() else 0.9
    return model


def labelled_spans(n: int = 2400, seed: int = 11) -> list[tuple[str, str, int, int, bool]]:
    """Labelled findings to train on: ``n`` made sentences with a span of known kind and truth.

    No table of findings is given, so these follow the ways that such spans are
    written; a caller with labelled findings of its own passes those instead.
    """
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    letters = lambda k: "".join(chr(97 + d) for d in rng.integers(0, 26, k))
    one = lambda options: options[int(rng.integers(len(options)))]
    filler = lambda k: " ".join(letters(int(rng.integers(2, 9))) for _ in range(k))
    out = []
    while len(out) < n:
        kind, good = one(KINDS), bool(rng.integers(2))
        hint = one(FOR if good else AGAINST) + one((" ", ": ", " is ", " no. ")) if rng.random() < 0.75 else ""
        if kind == "phone":
            span = one((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"00{digits(2)} {digits(3)} {digits(4)}"))
            hint = hint if good else one(AGAINST) + " "
        elif kind == "id":
            span = f"{1 + int(rng.integers(6))}{digits(2)}-{digits(2)}-{digits(4)}" if good else f"{one(('000', '666', '9' + digits(2)))}-{digits(2)}-{digits(4)}"
        elif kind == "iban":
            span = one(("DE", "FR", "GB", "ES", "NL")) + digits(2) + "".join(f" {digits(4)}" for _ in range(int(rng.integers(3, 6)))) if good else letters(2).upper() + digits(2) + "".join(letters(4).upper() for _ in range(3))
        elif kind == "email":
            span = f"{letters(6)}{one((' @ ', ' [at] ', '(at)', '[at]'))}{letters(7)}{one(('.', ' [dot] ', '(dot)'))}{one(('com', 'org', 'net', 'edu'))}" if good else f"{digits(2)} @ {digits(1)}.{digits(2)}"
        else:
            span = one((":", "-")).join(digits(1) + one("abcdef09") for _ in range(6)) if good else "-".join(digits(2) for _ in range(6))
            hint = hint if good else one(AGAINST) + " "
        before = f"{filler(int(rng.integers(1, 6)))} {hint}"
        out.append((before + span + one((" ", ". ", ", ")) + filler(3), kind, len(before), len(before) + len(span), good))
    return out


def train(findings: list[tuple[str, str, int, int, bool]] | None = None, **parameters) -> Boosted:
    """Fit on labelled findings ``(text, kind, start, end, is personal data)``, by default ``labelled_spans()``."""
    findings = labelled_spans() if findings is None else findings
    x = np.array([describe(t, k, a, b) for t, k, a, b, _ in findings])
    return boost(x, np.array([f[4] for f in findings]), [f[1] for f in findings], **parameters)


def added_spans(text: str, taken: list[tuple[str, int, int]], model: Boosted) -> list[tuple[str, int, int]]:
    """The candidates that pass their kind's threshold; of overlapping ones the best, the earlier and longer of equals."""
    proposed = candidates(text, taken)
    if not proposed:
        return []
    scores = model.score(np.array([describe(text, *c) for c in proposed]))
    chosen: list[tuple[str, int, int]] = []
    ends: list[int] = []  # starts and ends of the chosen, which do not overlap, in order
    for i in sorted(range(len(proposed)), key=lambda i: (-scores[i], proposed[i][1], -proposed[i][2], proposed[i][0])):
        kind, a, b = proposed[i]
        if scores[i] < model.thresholds[kind]:
            continue
        at = bisect_right(ends, a)
        if at % 2 == 0 and (at == len(ends) or ends[at] >= b):  # it begins outside of all, and ends before the next
            ends[at:at] = [a, b]
            chosen.append(proposed[i])
    return chosen


def _joined(spans: list[tuple[str, int, int]]) -> str:
    rank = {k: i for i, k in enumerate((*BASE, *(k for k in KINDS if k not in BASE)))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (rank[s[0]], s[1], s[2])))


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"


def find_personal_data(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """``doc_id`` and ``spans`` (``kind``, ``start``, ``end`` in code points, ``base``) of each whole text of ``docs``.

    Base spans are leftmost and do not overlap within a kind; added spans touch
    no base span and no other added one. A null or empty text has no spans.
    Repeated rows and null ids give a row each. Other columns are ignored.
    """
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text) if _ANY.search(text) else []
                more = added_spans(text, base, model) if _ANY.search(text) else []
                out.append([{"kind": k, "start": a, "end": b, "base": True} for k, a, b in base] + [{"kind": k, "start": a, "end": b, "base": False} for k, a, b in more])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, spans_type)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def personal_data_digest(found: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256``, ``spans`` as text, and ``n_spans`` (base and added) for each row of ``found``.

    Without spans the counts are 0, ``spans`` is empty and the digest is that of the
    empty string. Repeated rows and null ids give a row each; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("spans").to_pylist()
            base = [[(s["kind"], s["start"], s["end"]) for s in r if s["base"]] for r in rows]
            counts = [pa.array([sum(s[0] == k for s in r) for r in base], pa.int64()) for k in BASE]
            digests = [hashlib.sha256(_joined(r).encode()).hexdigest() for r in base]
            everything = [_joined([(s["kind"], s["start"], s["end"]) for s in r]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests), pa.array(everything), pa.array(list(map(len, rows)), pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"],
            )

    return found.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_spans long")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
