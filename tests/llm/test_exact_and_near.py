from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from corpusmill.llm import exact_dedup, simhash
from corpusmill.llm.queries import QUERIES

from .conftest import ODD


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_exact(rows):
    """Of rows that repeat a doc_id and a text, one stays."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), not k, hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k, (_, i) in enumerate(sorted(g)))


def test_exact_odd_rows(make):
    got = exact_dedup.exact_dedup(make(ODD)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == brute_exact(ODD)


def test_exact_empty_table(make):
    assert exact_dedup.exact_dedup(make(ODD).limit(0)).collect() == []
    assert exact_dedup.keep_first(make(ODD).limit(0)).collect() == []


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_in_batches(make, batches):
    """However many batches go through the index, the rows are the same, and no table is left."""
    rng = random.Random(8)
    rows = [(rng.randrange(200), rng.choice(["", None, " ", "a", "a ", "A", "b c", "b  c", "bc", f"x{i}"])) for i in range(300)]
    docs = make(rows)
    before = len(docs.sparkSession.catalog.listTables())
    got = exact_dedup.exact_dedup(docs, batches=batches).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == brute_exact(rows)
    assert len(docs.sparkSession.catalog.listTables()) == before


def test_index_over_batches(spark, make):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = exact_dedup.exact_dedup(make([(10, "a b"), (11, "c")]), index).collect()
    assert all(r.kept for r in first)
    second = {r.doc_id: r for r in exact_dedup.exact_dedup(make([(1, "ab"), (2, "new"), (3, "n e w"), (20, "c"), (21, " c")]), index).collect()}
    assert (second[1].keep_id, second[1].kept) == (10, False)  # the earlier row has more code points
    assert (second[2].keep_id, second[3].kept, second[2].group_size) == (3, True, 2)
    assert (second[20].keep_id, second[21].kept) == (21, True)  # more code points than the earlier row of that text
    assert sorted(r.keep_id for r in index.keepers().collect()) == [3, 10, 21]
    # what is new is found by a sort-merge anti-join that reads the index in its buckets, without a shuffle of it
    groups = exact_dedup.grouped(exact_dedup.digests(make([(1, "q")])).withColumn("row", exact_dedup.F.lit(1)))
    plan = index.lacking(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "BroadcastHashJoin" not in plan
    own = index.read().join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in own
    index.drop()


def test_keep_first_keeps_columns(make):
    docs = make(ODD)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, radius=4):
    ids = sorted(fps)
    a = np.array([fps[i] for i in ids], dtype=np.uint64)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(a[n + 1 :] ^ a[n]) <= radius):
            x, y = find(i), find(ids[n + 1 + int(m)])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op4_simhash"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


def test_simhash_odd_rows(make):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(make(ODD)).collect()}
    assert got[1] == got[2] == got[3] == got[8] == ("0" * 16, 1)
    assert got[4] == got[5]
    assert {i: f for i, (f, _) in got.items()} == {i: f"{brute_fingerprint(t):016x}" for i, t in ODD}
    assert simhash.simhash_components(make(ODD).limit(0)).collect() == []


def test_covering_masks_hide_any_few_bits():
    masks = simhash.covering_masks(4, list(range(64)))
    assert len(masks) == 31 and all(30 <= m.bit_count() <= 34 for m in masks)
    rng = random.Random(1)
    for _ in range(2000):
        d = sum(1 << p for p in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not d & m for m in masks)


@pytest.mark.parametrize("cap", [1 << 16, 3])
def test_links_find_all_components(spark, cap):
    """Chains, dense clusters and strangers; a small cap sends buckets to the finer split."""
    rng = random.Random(2)
    fps = {}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            fps[len(fps)] = centre
            if rng.random() < 0.5:
                centre ^= sum(1 << p for p in rng.sample(range(64), rng.randint(1, 5)))
            else:
                fps[len(fps)] = centre ^ sum(1 << p for p in rng.sample(range(64), rng.randint(1, 6)))
    for _ in range(50):
        fps[len(fps)] = rng.getrandbits(64)
    by_fp = {}
    for i, f in fps.items():
        by_fp.setdefault(f, i)
    nodes = {i: f for f, i in by_fp.items()}
    rows = spark.createDataFrame([(simhash.signed(f), i) for i, f in nodes.items()], "fp long, node long")
    linked = {r.node: r.component for r in simhash.components(simhash.fingerprint_links(rows, 4, cap)).collect()}
    assert {i: linked.get(i, i) for i in nodes} == brute_components(nodes)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 999)], "a long, b long")
    assert {r.node: r.component for r in simhash.components(links).collect()} == {**{i: 0 for i in range(1, 301)}, 1000: 999}


def test_keep_one(make):
    docs = make(ODD)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # document 4 stands there twice, and one of its rows stays
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7]
