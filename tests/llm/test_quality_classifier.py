"""Log-count ratios and the dual solution against plain restatements, and the bound on sampled features."""

import math
from collections import Counter

import numpy as np
import pytest

from asofkit.llm import quality_classifier as qc


@pytest.fixture(scope="module")
def sample():
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, 60, r.integers(0, 25))).astype(np.int32) for _ in range(120)]
    y = np.array([1 if (x < 12).sum() + r.normal() > 4 else -1 for x in rows])
    return rows, y


def test_ratios_equal_counted_ones(sample):
    rows, y = sample
    got = qc.log_count_ratio(rows, y)
    size = 1 << qc.BITS
    counts = {c: Counter(int(f) for x, t in zip(rows, y, strict=True) if t == c for f in x) for c in (1, -1)}
    for f in [*range(60), 100, size - 1]:
        share = {c: (counts[c][f] + 1) / (counts[c].total() + size) for c in (1, -1)}
        assert got[f] == pytest.approx(math.log(share[1] / share[-1]), abs=1e-6)


@pytest.mark.parametrize("c", [0.01, 0.1, 1.0])
def test_dual_descent_closes_the_duality_gap(sample, c):
    rows, y = sample
    scale = qc.log_count_ratio(rows, y)
    w, bias = qc.dual_descent(rows, y, scale, c, epochs=5000)
    x = np.zeros((len(rows), 61))
    for i, f in enumerate(rows):
        x[i, f] = scale[f]
    x[:, 60] = 1
    beta = np.r_[w[:60], bias]
    cost = np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2 * c
    slack = np.maximum(0, 1 - y * (x @ beta))
    primal = beta @ beta / 2 + (cost * slack**2).sum()
    alpha = 2 * cost * slack  # the dual point that belongs to the slacks
    from_dual = x.T @ (alpha * y)
    dual = alpha.sum() - from_dual @ from_dual / 2 - (alpha**2 / (4 * cost)).sum()
    assert np.allclose(from_dual, beta, atol=1e-3) and not w[60:].any()
    assert 0 <= primal - dual + 1e-9 <= 1e-4 * primal


def test_features_of_all_sampled_texts_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(qc, "fit_model", lambda rows, good, **_: seen.append((len(rows), sum(map(len, rows)))))
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(40_000))) for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    qc.train(docs, labels)
    qc.train(docs, labels, most_features=1 << qc.BITS)
    (all_rows, whole), (some, bounded) = seen
    assert 0 < some < all_rows and bounded <= 1 << qc.BITS < whole
    with pytest.raises(ValueError):
        qc.train(docs, labels, most_features=1000)
