"""Naive Bayes support vectors: a linear classifier of text quality.

Features are indicators of word and word-shape n-grams (n = 1, 2), hashed. Each
indicator is scaled by its class log-count ratio; a linear hinge-loss model on the
scaled indicators is fitted by dual coordinate descent and mixed with its mean weight.
A logistic curve through cross-fitted margins turns margins into scores.

The fit uses a bounded sample of labelled keys, ``sample`` (default 10,000), those
with the smallest hashes; beyond that the parameter has to be raised. Of a key with
several rows, the text with the smallest hash is used, so ``sample`` bounds the rows.
``most_features`` (default 20 million) bounds the features of all sampled texts together,
hence the driver's memory (4 bytes a feature) however long texts are: keys are taken by
hash up to the first one that no longer fits. A text has at most 2^18 features.
Scoring reads all rows. Rows whose key's checksum modulo 3 is 1 are held out of the
fit. Conflicting labels of a key are averaged, a tie counting as good; null labels are
left out. Without labels of both classes the score is the share of good labels (0.5
without any). A null text counts as empty and gets the score of no features. Repeated
rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.text import checkpointed, map_rows, mixed, word_hashes

BITS = 18
CLASSES = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))


def shapes(text: bytes) -> bytes:
    """The text with characters replaced by their class, runs of a class cut to two."""
    c = np.frombuffer(text.translate(CLASSES), np.uint8)
    if len(c) < 3:
        return c.tobytes()
    keep = np.ones(len(c), bool)
    keep[2:] = (c[2:] != c[1:-1]) | (c[1:-1] != c[:-2])
    return c[keep].tobytes()


def indicators(text: bytes | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text: 1- and 2-grams of words and of word shapes, and of stuttering."""
    text = text or b""
    found = []
    for salt, h in ((11, word_hashes(text.lower())), (13, word_hashes(shapes(text)))):
        if len(h):
            found += [mixed(h + np.uint64(salt)), mixed((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) ^ np.uint64(salt))]
            if salt == 11 and 10 * (h[1:] == h[:-1]).sum() >= len(h):
                found.append(np.full(1, 17, np.uint64))
    if not found:
        return np.zeros(0, np.int32)
    places = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32)
    if len(places) < 20_000:
        return np.unique(places)
    seen = np.zeros(1 << BITS, bool)
    seen[places] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # log-count ratios times hinge weights, by feature
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum(dtype=np.float64)) + self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -700, 700))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    total = np.full((2, 1 << BITS), alpha)
    for x, label in zip(rows, y, strict=True):
        total[int(label > 0), x] += 1
    total /= total.sum(axis=1, keepdims=True)
    return np.log(total[1] / total[0]).astype(np.float32)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised squared hinge loss, one dual variable at a time; the bias is a constant feature."""
    w, bias, alpha, scale = np.zeros(len(scale)), 0.0, np.zeros(len(rows)), scale.astype(np.float64)
    weight = np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2 * c  # both classes count alike
    diagonal = 0.5 / weight
    squares = scale * scale
    curve = np.array([squares[x].sum() + 1 for x in rows]) + diagonal
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            x = rows[i]
            values = scale[x]  # looked up anew, so that rows hold their feature numbers only
            gradient = y[i] * (w[x] @ values + bias) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / curve[i], 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * values
                bias += step
                largest = max(largest, abs(step))
                alpha[i] = new
        if largest < 1e-6:
            break
    return w, bias


def _linear(rows: list[np.ndarray], y: np.ndarray, c: float, epochs: int, mix: float) -> tuple[np.ndarray, float]:
    ratio = log_count_ratio(rows, y)
    w, bias = dual_descent(rows, y, ratio, c, epochs)
    used = np.zeros(len(w), bool)
    for x in rows:
        used[x] = True
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    return ((mix * w + (1 - mix) * mean * used) * ratio).astype(np.float32), bias


def _curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset by Newton steps, targets drawn in from 0 and 1."""
    a, b, n1, n0 = 1.0, 0.0, good.sum(), (1 - good).sum()
    t = np.where(good > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * (a - 1), (p - t).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-9]])
        da, db = np.linalg.solve(h, g)
        a, b = max(a - da, 1e-3), b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def fit_model(rows: list[np.ndarray], good: list[int], c: float = 0.1, epochs: int = 12, mix: float = 0.9, parts: int = 3) -> Model:
    y = np.where(np.asarray(good, int) > 0, 1, -1)
    if len(y) == 0 or abs(y.sum()) == len(y):
        share = 0.5 if len(y) == 0 else (1 + (y > 0).sum()) / (2 + len(y))
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    fold, margins = np.zeros(len(y), int), np.zeros(len(y))
    for label in (-1, 1):  # each part gets its share of both classes
        fold[y == label] = np.arange((y == label).sum()) % parts
    if min((y > 0).sum(), (y < 0).sum()) >= parts:
        for f in range(parts):
            w, b = _linear([x for x, k in zip(rows, fold, strict=True) if k != f], y[fold != f], c, epochs, mix)
            for i in np.flatnonzero(fold == f):
                margins[i] = w[rows[i]].sum(dtype=np.float64) + b
    w, b = _linear(rows, y, c, epochs, mix)
    if not margins.any():
        margins = np.array([w[x].sum(dtype=np.float64) + b for x in rows])
    return Model(w, b, *_curve(margins, (y > 0).astype(float)))


def held_out(key) -> F.Column:
    """Whether a key's rows are kept from the fit."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000, most_features: int = 20_000_000, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fits on at most ``sample`` labelled keys that are not held out, one row of each, ``most_features`` features in all."""
    if most_features < 1 << BITS:
        raise ValueError("most_features is below the features that one text may have")
    known = labels.select(F.col(key), F.col(label).alias("label")).where(F.col("label").isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    marked = known.groupBy(key).agg((F.avg("label") >= 0.5).cast("int").alias("good"))
    chosen = checkpointed(marked.orderBy(F.xxhash64(key), key).limit(sample))  # at most `sample` pairs of numbers, so it may be broadcast
    texts = docs.select(key, F.col(text).cast("binary").alias("body")).join(F.broadcast(chosen), key)
    one = texts.groupBy(key).agg(F.min("good").alias("good"), F.min_by("body", F.xxhash64("body")).alias("body"))  # aggregated before the shuffle, so a key may hold any share of rows
    rows = map_rows(one.select(key, "good", "body"), lambda k, g, t: [(k, g, indicators(t).tobytes())], f"{key} {docs.schema[key].dataType.simpleString()}, good int, features binary")
    rows = checkpointed(rows.withColumn("turn", F.xxhash64(key)))
    total, fits = 0, rows
    for turn, n in sorted((r["turn"], r["n"]) for r in rows.select("turn", (F.length("features") / 4).cast("long").alias("n")).collect()):  # `sample` pairs at most
        total += n
        if total > most_features:
            fits = rows.where(F.col("turn") < turn)
            break
    got = sorted((r[key], r["good"], bytes(r["features"])) for r in fits.toLocalIterator())
    return fit_model([np.frombuffer(x, np.int32) for _, _, x in got], [g for _, g, _ in got])


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, score in 0..1 and predicted."""

    def one(k, out, t):
        s = model.score(indicators(t))
        yield (k, out, s, int(s >= 0.5))

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key), held_out(key).alias("out"), F.col(text).cast("binary")), one, f"{key} {kind}, held_out boolean, score double, predicted int")
