"""Quality classifier: a linear SVM on n-gram indicators scaled by naive Bayes ratios.

Each n-gram that a text has counts once, with the log of the ratio of its share
in good and in bad texts. A hinge-loss model over these is fitted by dual
coordinate descent, and a sigmoid on rows that it has not seen turns its margin
into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text import chunks, code_points, give_back, runs

BITS = 18
_K = [np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_SHIFT = np.uint32(32 - BITS)


def _shapes(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for the shape of each blank-separated word, and the first word of each text.

    It tells a capital start, all capitals, digits, marks inside or at the end,
    the length, and whether the word repeats one of the two before it.
    """
    starts, ends, first = runs(points > 32, offsets)
    if not len(starts):
        return np.zeros(0, np.uint32), first
    upper = (points >= 65) & (points <= 90)
    digit = (points >= 48) & (points <= 57)
    mark = (points > 32) & (points < 128) & ~upper & ~digit & ~((points >= 97) & (points <= 122))
    n = ends - starts
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.stack([starts, ends])], axis=0)[0]
    n_upper, n_digit, n_mark = sums(upper), sums(digit), sums(mark)
    total = sums(points.astype(np.int64) * (1 + points.astype(np.int64) % 97))
    repeats = np.zeros(len(n), dtype=np.int64)
    place = np.arange(len(n)) - first[np.searchsorted(first, np.arange(len(n)), "right") - 1]  # within its text
    repeats[1:] |= (total[1:] == total[:-1]) & (place[1:] > 0)
    repeats[2:] |= 2 * ((total[2:] == total[:-2]) & (place[2:] > 1))
    shape = upper[starts] + 2 * (n_upper * 2 > n) + 4 * (n_digit > 0) + 8 * np.minimum(n_mark, 3) + 32 * mark[starts] + 64 * repeats + 256 * np.minimum(n // 4, 7)
    return shape.astype(np.uint32), first


def features(texts: list[str]) -> list[np.ndarray]:
    """The distinct hashed n-grams of each text: of 2 and 3 characters, and of 1 to 3 word shapes."""
    points, offsets = code_points(texts)
    x = points.astype(np.uint32)
    two = (x[:-1] * _K[0] + x[1:] * _K[1]) * _K[2] >> _SHIFT if len(x) > 1 else x[:0]
    three = (x[:-2] * _K[1] + x[1:-1] * _K[2] + x[2:] * _K[0]) * _K[0] >> _SHIFT if len(x) > 2 else x[:0]
    shape, first = _shapes(points, offsets)
    s1 = (shape + np.uint32(1)) * _K[1]
    s2 = s1[:-1] * _K[0] + s1[1:] if len(s1) > 1 else s1[:0]
    s3 = s2[:-1] * _K[2] + s1[2:] if len(s1) > 2 else s1[:0]
    shaped = [(s * _K[2] ^ s >> np.uint32(15)) * _K[0] >> _SHIFT for s in (s1, s2, s3)]
    seen = np.zeros(1 << BITS, dtype=bool)
    out = []
    for a, b, c, d in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first[:-1].tolist(), first[1:].tolist()):
        found = np.concatenate([two[a : max(a, b - 1)], three[a : max(a, b - 2)], *(s[c : max(c, d - k)] for k, s in enumerate(shaped))])
        if len(found) < 1000:
            out.append(np.unique(found))
            continue
        seen[found] = True
        out.append(np.flatnonzero(seen).astype(np.uint32))
        seen[found] = False
    return out


@dataclass
class Model:
    """``scaled`` holds weight times ratio, ``squares`` the squared ratio of each n-gram; a score is a sigmoid of the margin."""

    scaled: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        norm = float(self.squares[found].sum(dtype=np.float64)) ** 0.5
        return float(self.scaled[found].sum(dtype=np.float64)) / norm + self.bias if norm > 0 else self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def dual_coordinate_descent(
    flat: np.ndarray, values: np.ndarray, cuts: np.ndarray, use: np.ndarray, sign: np.ndarray, cost: float, epochs: int, seed: int
) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model of least hinge loss on rows ``use``; the bias is a feature of value one.

    Row ``i`` has the features ``flat[cuts[i]:cuts[i + 1]]`` with ``values`` at the same places.
    """
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(sign))
    rows = [slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    diagonal = np.array([float(values[r] @ values[r]) + 1.0 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(use).tolist():
            at, v = flat[rows[i]], values[rows[i]]
            gradient = sign[i] * (float(w[at] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def sigmoid_fit(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest sigmoid, with targets drawn in a little against certainty."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(margins))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)) @ x.T + 1e-6 * np.eye(2), x @ (p - target))
        theta = theta - np.clip(step, -2, 2)
    return float(max(theta[0], 1e-3)), float(theta[1])


def log_ratios(flat: np.ndarray, cuts: np.ndarray, good: np.ndarray, use: np.ndarray, smooth: float) -> np.ndarray:
    """For each n-gram the log of its share in good rows over that in bad rows, of rows ``use``."""
    counts = np.full((2, 1 << BITS), smooth)
    for i in use.tolist():
        counts[int(good[i]), flat[cuts[i] : cuts[i + 1]]] += 1  # the n-grams of a row are distinct
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def fit(flat: np.ndarray, cuts: np.ndarray, good: np.ndarray, cost: float = 1.0, smooth: float = 1.0, epochs: int = 30, seed: int = 7) -> Model:
    """A model from the n-grams of labelled texts, those of text ``i`` at ``flat[cuts[i]:cuts[i + 1]]``. Every fifth row sets the sigmoid alone."""
    held = np.arange(len(good)) % 5 == 4
    use = np.flatnonzero(~held)
    if len({*good[use].tolist()}) < 2:  # one class, or no rows: nothing to tell apart
        share = (float(good.sum()) + 1) / (len(good) + 2)
        zero = np.zeros(1 << BITS)
        return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    ratio = log_ratios(flat, cuts, good, use, smooth)
    values = np.empty(len(flat), dtype=np.float32)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        v = ratio[flat[a:b]]
        norm = float(v @ v) ** 0.5
        values[a:b] = v / norm if norm > 0 else v
    w, bias = dual_coordinate_descent(flat, values, cuts, use, np.where(good, 1.0, -1.0), cost, epochs, seed)
    margins = np.array([float(w[flat[a:b]] @ values[a:b]) + bias for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
    judge = held if len({*good[held].tolist()}) == 2 else np.ones(len(good), dtype=bool)
    slope, shift = sigmoid_fit(margins[judge], good[judge])
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, slope, shift)


def _featurizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in chunks(batch.column("text")):
            found = pa.array([f.astype("<u4").tobytes() for f in features(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, len(texts)) for c in ("id", "quality")] + [found], names=["id", "quality", "found"])


def held_out(doc_id: str = "doc_id"):
    """Whether an id's checksum sets it apart from training; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, grams: int = 1 << 24, **parameters) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out, those of least id hash.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad; other values and
    nulls are left out; an id with both values is left out). Of documents that
    repeat an id one counts. ``rows`` and ``grams``, the n-grams of all of them
    together, bound what the driver receives: if these are more, those of
    greatest id hash are left out.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("id"))
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("id", F.col("quality").cast("int"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(known), "id")  # at most ``rows``
    found = texts.mapInArrow(_featurizer, "id long, quality int, found binary").groupBy("id", "quality").agg(F.min("found").alias("found"))
    found = written(found.withColumn("order", F.xxhash64("id")), "grams")
    sizes = found.select("order", F.length("found").alias("n")).orderBy("order").toArrow()
    most = np.flatnonzero(np.cumsum(sizes["n"].to_numpy()) > 4 * grams)
    if len(most):
        found = found.where(F.col("order") < F.lit(sizes["order"][int(most[0])].as_py()))
    model = _fitted(found, parameters)
    give_back()
    return model


def _fitted(found: DataFrame, parameters: dict) -> Model:
    table = found.orderBy("order", "id").select("quality", "found").toArrow().combine_chunks()
    if not table.num_rows:
        return fit(np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool), **parameters)
    bytes_ = table["found"].chunk(0)
    cuts = np.frombuffer(bytes_.buffers()[1], dtype=np.int32)[bytes_.offset : bytes_.offset + len(bytes_) + 1] // 4
    flat = np.frombuffer(bytes_.buffers()[2], dtype="<u4") if cuts[-1] else np.zeros(0, np.uint32)
    return fit(flat, cuts.astype(np.int64), table["quality"].to_numpy() == 1, **parameters)


def with_score(docs: DataFrame, model: Model, to: str = "score", least: float | None = None, drop_text: bool = False) -> DataFrame:
    """``docs`` with a score of each whole text (null: empty), or only its rows of ``least`` or more without the score.

    A column of the score's name is replaced if the score is added. Repeated rows and null ids are scored like others; no rows give none.
    """
    kept = [c for c in docs.columns if not (drop_text and c == "text") and not (least is None and c == to)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                scores = np.array([model.score(f) for f in features(texts)])
                rows = batch.slice(at, len(texts)).select(kept)
                if least is None:
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores, pa.float64())], names=[*kept, to])
                else:
                    yield rows.filter(pa.array(scores >= least))

    return docs.mapInArrow(run, ", ".join(fields + ([f"`{to}` double"] if least is None else [])))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 6000) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    A null or empty text has no n-gram and gets the model's prior. Without
    labels of both classes all rows get the share of good ones. Repeated rows
    and null ids are scored like others. Only the text enters a score.
    """
    model = train(docs, labels, rows)
    scored = with_score(docs.select(F.col("doc_id").cast("long"), "text"), model, drop_text=True)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 6000) -> DataFrame:
    """``docs``, all columns, without the documents that score under ``threshold``.

    Null and empty texts have the model's prior as score; repeated rows go or stay together; no rows give none.
    """
    return with_score(docs, train(docs, labels, rows), least=threshold)
