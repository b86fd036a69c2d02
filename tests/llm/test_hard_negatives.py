"""Hard negatives against a search over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.llm import hard_negatives as hn

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, every, positives=5, negatives=10, low=30, high=90, scale=256):
    take = []
    for k, v, y in rows:
        if y is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        take.append((k, (y + 1) % 10 if k is not None and k % 7 == 0 else y, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = []
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for i, (k, y, v) in enumerate(take):
        if k is None or k % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, z == y) for n, (j, z, w) in enumerate(take) if n != i]
        for p, pid, _ in sorted((r for r in scored if r[2]), key=order)[:positives]:
            fit = sorted((r for r in scored if not r[2] and low * p <= 100 * r[0] <= high * p), key=order)[:negatives]
            out += [(k, pid, n + 1, j, p, s) for n, (s, j, _) in enumerate(fit)]
    return sorted(out, key=str)


def mined(df, every, group=hn.GROUP, entries=hn.ENTRIES):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = df.select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"))
    out = hn.mine(rows, F.col("id") % every == 0, group=group, entries=entries).collect()
    return sorted(((x.anchor_id, x.positive_id, x.rank, x.negative_id, x.positive_score, x.negative_score) for x in out), key=str)


def clustered(seed, n, labels=4, size=6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    return [(i, [x + r.gauss(0, 0.15) for x in r.choice(centres)], r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("seed", "group", "entries"), [(1, hn.GROUP, 8), (2, 60, 3), (3, 25, 1)])
def test_equals_all_pairs(spark, seed, group, entries):
    rows = clustered(seed, 400)
    rows += [rows[0]] * 3 + [(9, rows[5][1], 2), (None, rows[0][1], rows[0][2]), (None, rows[0][1], 3), (500, rows[0][1], None), (600, None, 1), (700, [1.0] * 5 + [None], 1)]
    rows += [(800, [float("nan")] * 6, 1), (900, [], 1), (1000, [0.0] * 6, 1), (1100, [-x for x in rows[0][1]], 0), (1200, [50.0 * x for x in rows[0][1]], rows[0][2])]
    r = random.Random(seed)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, ROWS).withColumn("q", F.lit(1)).withColumn("rank", F.lit(2)).repartition(5)
    want = brute(rows, 20)
    assert mined(df, 20, group, entries) == want and len(want) > 400


def test_ties_hot_label_and_large_components(spark):
    rows = [(i, [float(i % 3), float(i % 2) * 1000, 30_000.0 * (4 + i % 5), 1.0], 1 if i % 3 else i % 4) for i in range(240)]
    want = brute(rows, 30)
    assert mined(spark.createDataFrame(rows, ROWS), 30, group=50) == want and len({w[0] for w in want}) > 3


def test_no_rows(spark):
    none = spark.createDataFrame([(100, None, 2), (101, [1.0, 2.0], None), (None, [1.0, 2.0], 1)], ROWS)
    assert mined(none, 100) == [] and mined(none.limit(0), 100) == []
    assert mined(spark.createDataFrame([(100, [1.0, 2.0], 2)], ROWS), 100) == []


def test_bounds_hold_and_cells_are_skipped():
    r = np.random.default_rng(5)
    centres = r.normal(0, 300, (8, 16))
    x = np.floor(centres[r.integers(0, 8, 4000)] + r.normal(0, 10, (4000, 16))).astype(np.int64)
    labels = r.integers(0, 3, 4000)
    index = hn.MultiIndex(x, np.arange(4000), np.zeros(4000, bool), labels, hn.fit_halves(x[:500], 8))
    asked, seen = x[:20], 0
    for i, bounds in enumerate(zip(*index.bounds(asked), strict=True)):
        query = hn.limbs(asked[i : i + 1], index.bits)
        cells = list(index.cells(*bounds))
        assert sorted(c[1:] for c in cells) == [(a, b) for a, b in zip(index.starts, index.starts[1:], strict=False) if a < b]
        assert all(c[0] >= d[0] for c, d in zip(cells, cells[1:], strict=False))
        assert all(index.scores(a, b, query).max() <= bound for bound, a, b in cells)
        best = hn.Kept(6, -hn.ALL, hn.ALL)
        hn.search(index, bounds, query, int(labels[i]), [best], same_label=True)
        exact = np.sort((x[labels == labels[i]] @ asked[i]))[::-1][:6]
        assert [-s for s, _, _ in best.best] == exact.tolist()
        seen += sum(b - a for bound, a, b in cells if bound >= best.least)
    assert seen < 0.5 * 20 * 4000
