"""Repeated byte strings against a table of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np

from asofkit.llm import suffix_family as sf


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + sf.SPAN] for x in raw for i in range(len(x) - sf.SPAN + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - sf.SPAN + 1):
            if seen[x[i : i + sf.SPAN]] > 1:
                gone[i : i + sf.SPAN] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(x), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=False) if not g)).hexdigest()))
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    pool = [make(120) for _ in range(6)]
    out = []
    for i in range(70):
        parts = [make(r.randrange(60))]
        if i % 3:
            p = r.choice(pool)
            a = r.randrange(len(p))
            parts += [p[a : a + r.randrange(150, 420)], make(r.randrange(30))]
        out.append("".join(parts))
    near = pool[0] + pool[1]
    out += [near[:k] + "#" + near[k + 1 :] for k in range(0, len(near), 230)]
    out += [pool[2], pool[2], pool[3] + pool[3], "ab" * 400, "ab" * 150, "x" * 199, "x" * 200, "y" * 201, "", None, "0123456789" * 19 + "012345678", pool[4][:199], pool[4][:200]]
    return out


def test_equal_to_a_table_of_all_strings(spark, docs_of):
    for seed, parts in ((1, 5), (2, 1)):
        cases = texts(seed)
        docs = docs_of(list(enumerate(cases)) + [(900, cases[3]), (900, cases[3]), (None, "z" * 100)]).repartition(parts)
        want = dict(enumerate(brute(cases + [cases[3], cases[3], "z" * 100])))
        got = sf.remove_repeats(docs).collect()
        assert len(got) == len(want)
        for x in got:
            i = len(cases) if x.doc_id == 900 else len(cases) + 2 if x.doc_id is None else x.doc_id
            assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[i], (i, cases[i][:50] if i < len(cases) and cases[i] else None)


def test_chunks_and_batches_do_not_matter(spark, docs_of, monkeypatch):
    monkeypatch.setattr(sf, "CHUNK", 64)
    cases = texts(3)
    chunks = [x for t in cases for x in sf.sampled((t or "").encode(), 1)]
    covered = sum(int(x["more"].sum()) + len(x) for x in chunks)
    assert covered == sum(max(0, len((t or "").encode()) - sf.SPAN + 1) for t in cases)  # each string in one block


def test_family_levels_equal_one_sort():
    r = np.random.default_rng(5)
    batches = []
    for _ in range(13):
        e = np.zeros(r.integers(1, 300), sf.SUFFIX)
        e["key"], e["block"], e["row"] = r.integers(0, 400, len(e)), r.integers(0, 3, len(e)), r.integers(0, 10**9, len(e))
        batches.append(e)
    family = sf.Family()
    for b in batches:
        family.add(b.copy())
        sizes = [len(x).bit_length() for x in family.levels]
        assert sizes == sorted(set(sizes), reverse=True)  # geometrically shrinking
    whole = sf.in_order(np.concatenate(batches))
    sf.scan_within(whole)
    got = family.whole()
    have = sorted(zip(got["key"], got["block"], got["row"], got["found"], got["open"], strict=True))
    assert have == sorted(zip(whole["key"], whole["block"], whole["row"], whole["found"], whole["open"], strict=True))


def test_edges(spark, edge_docs):
    got = {(x.doc_id, x.n_bytes): x for x in sf.remove_repeats(edge_docs).collect()}
    assert got[5, 300_000].n_removed == 300_000 and got[5, 300_000].n_spans == 1 and got[6, 300_000].n_removed == 300_000
    assert got[1, 0].n_removed == 0 and got[1, 0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert sf.remove_repeats(edge_docs.limit(0)).collect() == []


def test_hot_beginning_is_not_dealt_by_its_key(spark, docs_of, monkeypatch):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    footer = word(330)
    cases = [word(r.randrange(20, 300)) + footer[r.randrange(20) :] + word(r.randrange(20, 300)) for _ in range(150)] + [word(400) for _ in range(30)]
    plans = []
    kept = sf.checkpointed
    monkeypatch.setattr(sf, "checkpointed", lambda df: (plans.append(df._jdf.queryExecution().toString()), kept(df))[1])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in sf.remove_repeats(docs_of(list(enumerate(cases)))).collect()}
    assert got == dict(enumerate(brute(cases)))
    assert plans and not any("hashpartitioning(key#" in p for p in plans)


def test_chunk_leaves_one_of_a_string_that_many_blocks_share():
    shared = bytes(range(7, 7 + sf.SPAN))
    strings, ranges = sf.packed_strings([(5, row, 10, 2, bytes([row]) + shared) for row in range(150)])
    assert sorted(strings["place"].tolist()) == [-1] + [10] * 150  # each block's own string, and the shared one once
    assert [tuple(x) for x in ranges.tolist()] == [(row, 11, 11) for row in range(150)]
