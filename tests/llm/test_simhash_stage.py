"""The pipeline's near-dedup stage takes candidates from SimHash."""

from __future__ import annotations

import random

import corpus_pipeline
from corpusmill.llm import shingles


def test_simhash_alone_finds_close_copies(make, spark, monkeypatch):
    """Without the bands, copies within four bits are still found and verified; what SimHash links below 0.8 stays."""
    monkeypatch.setattr(shingles, "buckets", lambda rows: rows.selectExpr("node AS bucket", "node").limit(0))
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [(1, " ".join(words)), (2, " ".join([*words[:-1], "z"])), (3, "a b c d"), (4, "A b\tc d"), (5, "other words are here now and then")]
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, make(texts), "").collect()} == {1, 3, 5}
