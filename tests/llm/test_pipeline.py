from __future__ import annotations

import corpus_pipeline
from corpusmill.llm import packing, toxicity
from corpusmill.llm.queries import tokenizer_path

from .test_decontaminate import brute as brute_contamination
from .conftest import ODD
from .test_exact_and_near import brute_exact


def brute_similar(texts, k=5):
    """Of texts whose sets of five-word shingles are linked at a similarity of 0.8 or more, the least id of each component."""
    sets = {}
    for i, t in texts:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    by_shingle, root = {}, {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in sets.items():
        for x in own or {()}:
            by_shingle.setdefault(x, []).append(i)
    for i, own in sets.items():
        for j in {j for x in own or {()} for j in by_shingle[x] if j > i}:
            if len(own & sets[j]) * 5 >= len(own | sets[j]) * 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in sets}


def test_each_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    read = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    docs = {r.doc_id: r for r in read.collect()}

    scores = {r.doc_id: r.score for r in toxicity.fit_toxicity(read, labels).score(read).collect()}
    out = stages[names[0]](spark, read, sf)
    assert out.columns == read.columns
    left = {r.doc_id for r in out.collect()}
    assert left == {i for i, s in scores.items() if s < 0.7} and len(left) < len(docs)

    def texts(ids):
        return [(i, docs[i].text) for i in sorted(ids)]

    def frame(ids):
        return spark.createDataFrame([docs[i] for i in sorted(ids)], read.schema)

    def step(name, ids):
        out = stages[name](spark, frame(ids), sf)
        assert out.columns == read.columns
        return {r.doc_id for r in out.collect()}

    kept = step(names[1], left)
    assert kept == {i for i, *_, keep, _ in brute_exact(texts(left)) if keep}
    near = step(names[2], kept)
    assert near == brute_similar(texts(kept)) and len(near) < len(kept)
    clean = step(names[3], near)
    found = brute_contamination(texts(near), [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert clean == {i for i in near if not found[i][4]}
    ids = packing.encoder(tokenizer_path())
    import pyarrow as pa

    want = {i: len(ids.batch(pa.array([t]))[0]) for i, t in texts(clean)}
    got: dict[int, int] = {}
    for p in stages[names[4]](spark, frame(clean), sf).collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want

    whole: dict[int, int] = {}
    for p in corpus_pipeline.run(spark, sf).collect():
        whole[p.doc_id] = whole.get(p.doc_id, 0) + p.length
    assert whole == want


def test_stages_on_odd_rows_and_empty_tables(spark, make):
    """Nulls, empty and very long texts, repeated rows and clashing columns pass every stage; an empty table stays empty."""
    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    clash = make([*ODD, (9, " ".join(f"w{i}" for i in range(40)))]).selectExpr("*", "1 AS __row", "2 AS __gone", "3 AS __again", "4 AS group", "5 AS node", "true AS kept")
    for docs in (clash, clash.limit(0)):
        rows = docs.count()
        for name in list(stages)[:-1]:
            out = stages[name](spark, docs, sf)
            assert out.columns == docs.columns
            got = sorted((r.doc_id, r.text or "") for r in out.collect())
            # toxicity and decontamination keep all of these; of equal texts one row stays
            if name in ("toxicity", "benchmark_decontamination"):
                assert len(got) == rows
            else:
                assert len(got) == len(set(got)) and (not rows or [i for i, _ in got] == {"exact_dedup": [3, 4, 5, 6, 7, 9], "simhash_near_dedup": [1, 4, 6, 7, 9]}[name])
        assert (stages["packing"](spark, docs, sf).count() > 0) == bool(rows)
