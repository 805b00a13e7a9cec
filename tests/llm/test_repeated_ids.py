"""De-duplication decides by row where rows repeat a doc_id."""

from __future__ import annotations

import corpus_pipeline
from corpusmill.llm import exact_dedup, shingles

from .conftest import ODD

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, LONG), (2, LONG), (2, "only here"), (3, "twice"), (3, "twice"), (4, "a b"), (4, "ab "), (4, " a b")]


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_exact_stage_keeps_one_row_a_text(spark, make):
    docs = make(ROWS)
    assert rows_of(corpus_pipeline.drop_copies(spark, docs, "")) == [(1, LONG), (2, "only here"), (3, "twice"), (4, " a b")]
    kept = exact_dedup.keep_first(make(ODD))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]


def test_near_stage_keeps_one_row_a_component(spark, make):
    near = LONG.replace("w0 ", "v0 ")
    docs = make([(1, LONG), (2, near), (2, "only here"), (3, "twice"), (3, "twice")])
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert rows_of(kept) == [(1, LONG), (2, "only here"), (3, "twice")]
    assert sorted(r.doc_id for r in shingles.keep_one(make(ODD)).collect()) == [1, 4, 6, 7]
