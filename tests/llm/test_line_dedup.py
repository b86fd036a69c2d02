"""Line dedup against a brute-force version."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from asofkit.llm import line_dedup
from tests_llm_brute import lower

WHITE = " \t\n\x0b\x0c\r"


def brute(texts, min_chars=1, min_docs=10):
    split = [(t or "").split("\n") for t in texts]
    keys = [[lower(x.strip(WHITE)) for x in lines] for lines in split]
    common = Counter(k for own in keys for k in set(own) if len(k) >= min_chars)
    return [(len(lines), "\n".join(x for x, k in zip(lines, own) if not (len(k) >= min_chars and common[k] >= min_docs))) for lines, own in zip(split, keys)]


def random_texts(seed, n=120):
    r = random.Random(seed)
    shared = ["All rights reserved.", " ALL RIGHTS RESERVED.\t", "x", "", " ", "Ünï", "ÜNÏ", "end\r", "end", " end"]
    return [None, "", "\n", "\n\n"] + ["\n".join(r.choice(shared) if r.random() < 0.6 else f"line {r.randrange(60)}" for _ in range(r.randrange(1, 12))) for _ in range(n)]


@pytest.mark.parametrize(("min_chars", "min_docs", "heavy"), [(1, 10, 50_000), (2, 3, 50_000), (1, 1, 4), (4, 1000, 50_000), (1, 5, 20)])
def test_equals_brute_force(spark, docs_of, min_chars, min_docs, heavy):
    texts = random_texts(min_docs)
    docs = docs_of(list(enumerate(texts))).repartition(5)
    want = brute(texts, min_chars, min_docs)
    got = {x.doc_id: x for x in line_dedup.line_digests(docs, min_chars=min_chars, min_docs=min_docs, heavy=heavy).collect()}
    assert len(got) == len(texts)
    for i, (t, (n, kept)) in enumerate(zip(texts, want, strict=True)):
        x = got[i]
        assert (x.n_lines, x.kept_sha256) == (n, hashlib.sha256(kept.encode()).hexdigest()), t
        assert (x.n_dropped > 0) == (kept != (t or "") or x.n_dropped == n)
    texts_out = {x.doc_id: x.text for x in line_dedup.without_common_lines(docs, min_chars=min_chars, min_docs=min_docs, heavy=heavy).collect()}
    assert [texts_out[i] for i in range(len(texts))] == [k for _, k in want]


def test_edges_repeats_and_clashing_names(spark, docs_of, edge_docs):
    rows = edge_docs.withColumn("row", F.lit(1)).withColumn("lines", F.lit(2)).withColumn("drops", F.lit(3)).withColumn("doc", F.lit(4)).withColumn("h1", F.lit(5))
    out = line_dedup.without_common_lines(rows)
    assert out.columns == rows.columns and out.count() == rows.count()
    assert line_dedup.line_digests(rows.limit(0)).collect() == []
    same = docs_of([(1, "a\nb\nc")] * 9 + [(None, "a"), (None, None)])  # equal rows count one by one
    got = sorted((x.doc_id or 0, x.n_lines, x.n_dropped) for x in line_dedup.line_digests(same).collect())
    assert got == [(0, 1, 0), (0, 1, 1)] + [(1, 3, 1)] * 9


def test_plan_has_no_python(spark, docs_of):
    plan = line_dedup.line_digests(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan
