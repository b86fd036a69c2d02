"""Joins between texts against plain restatements of their contracts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from asofkit.llm import decontaminate, jaccard_join
from asofkit.llm.components import components
from tests_llm_brute import bench_words, brute_components, brute_hits, shingles


def test_hits_equal_every_window_looked_for(spark, docs_of, edge_docs):
    r = random.Random(4)
    vocabulary = ["alpha", "Beta", "g7", "δέλτα", "e", "zeta"]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, make(r.choice([3, 9, 10, 11, 14, 30]))) for i in range(40)] + [(40, None), (41, " - "), (7, make(12)), (None, make(13)), (42, "rare")]
    docs = []
    for i in range(120):
        t = make(r.randrange(40))
        if i % 2:
            w = bench_words(r.choice([x for _, x in items if x and len(x) > 5]))
            a = r.randrange(max(1, len(w) - 9))
            t = t + ", " + "--".join(x.upper() if r.random() < 0.3 else x for x in w[a : a + r.randrange(5, 14)]) + "; " + make(5)
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, "a rare thing"), (3, docs[3][1]), (3, "another text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hit_table(docs_of(docs), bench).collect()
    assert len(got) == len(docs)
    want = sorted((k, n, h, ",".join(sorted(str(x) for x in f if x is not None))) for k, t in docs for n, h, f in [brute_hits(t, items)])
    have = sorted((x.doc_id, x.n_words, x.n_hit, next(w for *_, w in want if hashlib.sha256(w.encode()).hexdigest() == x.items_sha256)) for x in got)
    assert have == want and any(h for _, _, h, _ in want)
    assert all(x.contaminated == (x.n_hit > 0) for x in got)
    clean = decontaminate.clean_documents(docs_of(docs), bench)
    assert sorted(x.doc_id for x in clean.collect()) == sorted(k for k, t in docs if not brute_hits(t, items)[1])
    assert decontaminate.hit_table(edge_docs, bench).count() == 9
    assert decontaminate.hit_table(edge_docs.limit(0), bench).collect() == []
    assert not any(x.contaminated for x in decontaminate.hit_table(edge_docs, bench.limit(0)).collect())


def test_words_equal_under_polynomial_hashes_differ(spark, docs_of):
    morse = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    docs = docs_of([(1, morse), (2, morse.translate(str.maketrans("ab", "ba")))])
    assert sorted(x.component_id for x in jaccard_join.join_table(docs).collect()) == [1, 2]
    got = decontaminate.hit_table(docs, spark.createDataFrame([(1, morse)], "item_id long, text string")).collect()
    assert {x.doc_id: x.n_hit for x in got} == {1: 1, 2: 0}


def test_columns_of_any_name_stay(spark, docs_of):
    docs = docs_of([(i, "one two three four five six" if i < 3 else f"text {i} of its own words") for i in range(6)])
    for name in ("__h", "__k", "__t", "__row", "__stays", "h", "t", "doc", "t_key", "hit", "hit_row", "stays"):
        docs = docs.withColumn(name, F.lit(name))
    kept = jaccard_join.one_per_component(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [0, 3, 4, 5]
    clean = decontaminate.clean_documents(docs, spark.createDataFrame([(1, "one two three four five")], "item_id long, text string"))
    assert clean.columns == docs.columns and sorted(x.doc_id for x in clean.collect()) == [3, 4, 5]


def near_texts(seed, groups=12, copies=9, length=60):
    r = random.Random(seed)
    out = []
    passage = " ".join(f"common{i}" for i in range(12))
    for g in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(6, length))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            if r.random() < 0.3:
                w += [f"t{r.randrange(10**6)}" for _ in range(r.randrange(8))]
            out.append(" ".join(w) + (" " + passage if g % 2 else ""))
    return out


def test_components_equal_all_pairs(spark, docs_of, edge_docs):
    for seed in (1, 2):
        texts = near_texts(seed) + ["", None, "one two", "ONE two", "one two three", "a b c d e", "a b c d e", " \n"]
        random.Random(seed).shuffle(texts)
        docs = list(enumerate(texts)) + [(500, texts[5]), (500, texts[5])]
        got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.join_table(docs_of(docs).repartition(5)).collect())
        assert got == brute_components(docs)
        kept = jaccard_join.one_per_component(docs_of(docs))
        sets = sorted({c for _, n, c in got if n})
        assert sorted(x.doc_id for x in kept.collect() if shingles(x.text)) == sets
        assert sum(not shingles(x.text) for x in kept.collect()) == sum(not shingles(t) for t in texts)
    assert jaccard_join.join_table(edge_docs).count() == 9
    assert jaccard_join.join_table(edge_docs.limit(0)).collect() == []


def test_frequent_elements_only_order(spark, docs_of, monkeypatch):
    texts = near_texts(7, groups=6, copies=20)
    docs = list(enumerate(texts))
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.join_table(docs_of(docs)).collect()) == brute_components(docs)


def test_integer_bounds():
    for a in range(1, 60):
        for b in range(1, 60):
            reach = [i for i in range(min(a, b) + 1) if 100 * i >= 80 * (a + b - i)]
            assert not reach or min(reach) == jaccard_join.needed(a, b)
            assert not reach or a - jaccard_join.prefix_size(a) + 1 <= min(reach)


def test_connected_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(120)] + [(5, k) for k in range(6, 60)] + [(9, 9)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_links_equal_all_pairs_of_different_sets(spark, docs_of, monkeypatch):
    tails = [" ".join(f"w{g}x{i}" for i in range(80)) + "".join(f" t{g}y{c}z{i}" for i in range(2 * c)) for g in range(3) for c in range(12)]
    texts = near_texts(3, groups=3, copies=5) + tails + tails[:2] + ["a b c d e", "a b c d e", "", None]
    docs = docs_of(list(enumerate(texts)))
    sets = [frozenset(shingles(t)) for t in texts]
    names = {x.doc_id: x.class_id for x in jaccard_join.join_table(docs).collect()}
    rows = Counter(names[i] for i, s in enumerate(sets) if s)
    want = set()
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and s != sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = sorted((names[i], names[j]))
                want.add((a, b, rows[a], rows[b]))
    assert len(want) > len(texts)  # more links than a tree of components needs
    for size in (10_000, 3):
        monkeypatch.setattr(jaccard_join, "LONG", size)
        got = [tuple(x) for x in jaccard_join.links(docs).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("held", [1, 50, 10**6])
def test_a_list_passes_its_open_pairs_on_in_batches(monkeypatch, held):
    n = 60
    monkeypatch.setattr(jaccard_join, "HELD_PAIRS", held)
    names = np.arange(100, 100 + n)
    columns = {"element": np.full(n, 7), "name": names, "n": np.full(n, 50), "at": np.zeros(n, int), "lead": np.r_[names[1], np.full(n - 1, names[0])], "near": names - 1, "root": names}
    batch = pa.RecordBatch.from_pydict({c: pa.array(v.astype(np.int64)) for c, v in columns.items()})
    got = [(a, b) for r in jaccard_join._open_pairs(iter([batch.slice(0, 25), batch.slice(25)])) for a, b in zip(*(c.to_pylist() for c in r.columns), strict=True)]
    want = {(a, b) for a in names.tolist() for b in names.tolist() if a < b and a != 100 and b != a + 1}
    assert set(got) == want and len(got) == len(want)
