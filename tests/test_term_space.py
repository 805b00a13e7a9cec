"""Vectors and sketches added up in blocks, against those of all pairs."""

from __future__ import annotations

from corpusmill.operators import models, ngrams, term_space


def test_blocks_add_up_to_the_vectors_of_all_pairs(spark, monkeypatch):
    """Repeated terms, terms next to themselves, many small blocks; pairs are not exchanged."""
    monkeypatch.setattr(term_space, "FLUSH", 5)
    monkeypatch.setattr(term_space, "DENSE", 2)
    texts = ["apple apple banana", "cherry", "", "東京 大阪 京都 奈良 東京 神戸", "apple banana cherry date apple elder fig grape"] * 3
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    pairs = ngrams.cooccurrence(rows)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    got = term_space.vectors(rows)
    assert "neighbour" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert key(got) == key(models.term_vectors(pairs))
    assert key(term_space.sketches(rows)) == key(models.sketches(models.term_vectors(pairs)))
    assert term_space.vectors(rows.limit(0)).collect() == []
