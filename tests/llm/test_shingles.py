"""The pipeline's near-dedup stage against brute force on five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
from corpusmill.llm import shingles

from .conftest import ODD


def brute_sets(texts):
    out = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        k = min(5, len(words))
        out[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if k else set()
    return out


def alike(x, y):
    both = len(x & y)
    return x == y or 5 * both >= 4 * (len(x) + len(y) - both)


def brute_kept(texts):
    sets = brute_sets(texts)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def test_stage_drops_copies_of_similarity_080_to_095(spark, make):
    """Pairs of a text and its copy with words replaced, five bits apart and more; and pairs just below 0.8, which stay."""
    rng = random.Random(3)
    texts, close = {}, 0
    for changes in (1, 2, 3, 4, 5, 6) * 10:
        words = [f"w{rng.randrange(10**6)}" for _ in range(240)]
        copy = list(words)
        for at in rng.sample(range(5, 235, 8), changes):
            copy[at] = f"v{at}"
        texts[len(texts)] = " ".join(words)
        texts[len(texts)] = " ".join(copy)
        close += changes <= 5
    want = brute_kept(texts)
    assert len(want) == len(texts) - close
    docs = make(list(texts.items()))
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want


def test_stage_on_a_table(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == brute_kept({r.doc_id: r.text for r in docs.collect()})


def test_dense_groups_and_chains(make, spark):
    rng = random.Random(4)
    texts = {}
    base = [f"w{i}" for i in range(120)]
    for _ in range(150):  # a dense group
        copy = list(base)
        copy[rng.randrange(120)] = f"x{len(texts)}"
        texts[len(texts)] = " ".join(copy)
    link = [f"c{i}" for i in range(120)]
    for _ in range(12):  # each like the next only
        texts[len(texts)] = " ".join(link)
        link = link[6:] + [f"d{len(texts)}_{i}" for i in range(6)]
    want = brute_kept(texts)
    assert {r.doc_id for r in shingles.keep_one(make(list(texts.items()))).collect()} == want


def test_odd_rows(make):
    docs = make(ODD)
    kept = shingles.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == [1, 4, 6, 7]
    assert shingles.keep_one(docs.limit(0)).collect() == []
