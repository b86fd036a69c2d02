"""Exact products and product codes against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.llm import product_codes
from asofkit.llm.exact_gemm import exact_product, floor_scaled, largest_component, limb_bits, limbs

ROWS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("length", "largest"), [(1, 2**29), (16, 2**10), (16, 2**28), (700, 2**25)])
def test_products_are_exact(length, largest):
    r = np.random.default_rng(length)
    a, b = (r.integers(-largest, largest + 1, (n, length)) for n in (7, 9))
    a[0], b[0] = largest, -largest
    bits = limb_bits(length)
    assert length * (2**bits - 1) ** 2 < 2**53
    want = a.astype(object) @ b.T.astype(object)
    assert (exact_product(limbs(a, bits), limbs(b, bits), bits).astype(object) == want).all()
    with pytest.raises(ValueError):
        floor_scaled(np.array([2.0 * largest_component(length)]), 1, length)


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    whole = [(k, [math.floor(scale * x) for x in v], y) for k, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not whole:
        return [], ""
    d = len(whole[0][1]) // parts
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[x[p * d : p * d + d] for _, x, _ in first] for p in range(parts)]

    def nearest(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x[p * d : p * d + d], e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(x, p)[1] for p in range(parts)] for _, x, _ in whole]
        for p in range(parts):
            for i in set(f[p] for f in found):
                own = [x[p * d : p * d + d] for (_, x, _), f in zip(whole, found, strict=True) if f[p] == i]
                books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    coded = [(k, [nearest(x, p) for p in range(parts)], y) for k, x, y in whole]
    errors = {}
    for _, f, y in coded:
        errors[y] = errors.get(y, 0) + sum(e for e, _ in f)
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((k is None, k or 0, "".join(f"{i:02x}" for _, i in f), sum(e for e, _ in f), errors[y]) for k, f, y in coded), digest


def result(df):
    rows = product_codes.code_table(df).collect()
    return sorted((x.vec_id is None, x.vec_id or 0, x.code, x.error, x.label_error) for x in rows), {x.codebooks_sha256 for x in rows}


def test_codes_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(r.randrange(10**6), [r.gauss(0, 0.2) for _ in range(8)], r.choice([None, 1, 2, 3])) for _ in range(500)]
    rows += [rows[0]] * 5 + [(rows[1][0], [0.5] * 8, 1), (None, [0.1] * 8, 9), (5, None, 1), (6, [0.1] * 7 + [None], 1), (7, [float("nan")] + [0.0] * 7, 1), (8, [float("inf")] * 8, 1), (9, [], 1)]
    rows += [(20 + i, [100.0 * i] * 8, 4) for i in range(3)]
    df = spark.createDataFrame(rows, ROWS).repartition(6)
    as_float = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for k, v, y in rows]
    want, digest = brute(as_float)
    assert result(df) == (want, {digest})


def test_large_components_need_several_limbs(spark):
    r = random.Random(4)
    rows = [(i, [float(r.randrange(-(2**18), 2**18)) for _ in range(4)], i % 2) for i in range(300)]
    want, digest = brute(rows)
    assert result(spark.createDataFrame(rows, ROWS)) == (want, {digest})


def test_few_rows_empty_tables_and_bad_shapes(spark):
    few = [(i, [i / 7, 0.0, -i / 3, 1.0], None) for i in range(3)]
    want, digest = brute([(k, [float(np.float32(x)) for x in v], y) for k, v, y in few])
    assert result(spark.createDataFrame(few, ROWS).withColumn("code", F.lit(1)).withColumn("error", F.lit(2))) == (want, {digest})
    empty = spark.createDataFrame([(1, None, 2)], ROWS)
    assert result(empty) == ([], set()) and result(empty.limit(0)) == ([], set())
    with pytest.raises(Exception, match="equal parts"):
        result(spark.createDataFrame([(1, [1.0] * 6, 2)], ROWS))
    with pytest.raises(Exception, match="different lengths"):
        result(spark.createDataFrame([(1, [1.0] * 8, 2), (2, [1.0] * 4, 2)], ROWS).coalesce(1))


def test_label_errors_through_both_joins(spark):
    coded = spark.createDataFrame([(i, None if i % 5 == 0 else i % 40 if i % 2 else 7, i) for i in range(400)], "vec_id long, label int, error long")
    want = {r["label"]: r["e"] for r in coded.groupBy("label").agg(F.sum("error").alias("e")).collect()}
    for heavy in (4, 50_000):
        got = product_codes.with_label_error(coded, heavy=heavy).collect()
        assert len(got) == 400 and all(x.label_error == want[x.label] for x in got)
