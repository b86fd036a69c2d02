"""The pipeline against brute-force versions of its stages."""

import random

import pytest

import corpus_pipeline
from asofkit.llm import pii, quality_rules
from tests_llm_brute import brute_components, brute_hits


@pytest.fixture()
def tables(spark, docs_of, tmp_path):
    r = random.Random(8)
    vocabulary = ["the", "of", "and", "was", "that"] + [f"word{i}" for i in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) + ("." if i % 11 == 10 else "") for i in range(n))
    items = [(i, prose(15)) for i in range(5)]
    docs = [(i, prose(r.randrange(60, 120))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " tail") for i in range(10)] + [(110, docs[3][1]), (3, docs[3][1])]
    docs += [(120 + i, docs[i + 20][1] + " " + items[i][1]) for i in range(5)]
    docs += [(130 + i, " ".join(w.upper() + "!!" for w in prose(80).split())) for i in range(4)] + [(140, None), (141, ""), (142, "short text")]
    docs += [(150 + i, prose(70) + f" a{i}.b@mail.example.com " + prose(5)) for i in range(3)]
    docs_of(docs).drop("kept", "n_tokens", "shard", "spans").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, items


def test_stages_equal_their_brute_versions(spark, tables):
    folder, docs, items = tables
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    kept = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/out{i}")
        now = spark.read.parquet(f"{folder}/out{i}")
        got = now.collect()
        if i == 0:
            w = quality_rules.weigh_rules(spark.read.parquet(f"{folder}/documents.parquet"))
            feats = [(k, t, quality_rules.features((t or "").encode())) for k, t in docs]
            kept = [(k, t) for k, t, f in feats if not quality_rules.base_failed(f) and w.posterior(quality_rules.votes(f)) >= 0.5]
            assert {130, 140, 141, 142}.isdisjoint(k for k, _ in kept) and len(kept) > 70
        elif i == 1:
            reps = {c for _, _, c in brute_components(kept)}
            kept = [(k, t) for k, t in dict.fromkeys(kept) if k in reps]
            assert 110 not in reps and 100 not in reps
        elif i == 2:
            kept = [(k, t) for k, t in kept if not brute_hits(t, items)[1]]
        elif i == 3:
            kept = [(k, pii.mask(t)) for k, t in kept]
            assert all(x.n_chars == len(x.text) and "@" not in x.text for x in got)
        if i < 4:
            assert now.columns == columns and sorted((x.doc_id, x.text) for x in got) == sorted(kept), name
        else:
            assert sorted(x.doc_id for x in got) == sorted(k for k, _ in kept) and all(x.round_trip and len(x.token_ids) == x.n_tokens for x in got)


def test_run_and_empty_table(spark, tables, tmp_path):
    folder, *_ = tables
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
