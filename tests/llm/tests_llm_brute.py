"""Brute-force restatements shared by several tests."""

import re


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def bench_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


def brute_hits(text, items):
    words = bench_words(text)
    hit, found = set(), set()
    for k, t in items:
        w = bench_words(t)
        windows = [w] if 0 < len(w) < 10 else [w[i : i + 10] for i in range(len(w) - 9)]
        for x in windows:
            for i in range(len(words) - len(x) + 1):
                if words[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found.add(k)
    return len(words), len(hit), found


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", lower(t))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(docs):
        low.setdefault(find(i), []).append(k)
    return sorted((k, len(s), min(x for x in low[find(i)] if x is not None) if s else k) for i, ((k, _), s) in enumerate(zip(docs, sets, strict=True)))
