"""Queries over vectors on small tables of their own."""

from __future__ import annotations

import pytest

from corpusmill.plans import registry

from .sqlcheck import same

registry.load()


@pytest.fixture
def vectors(spark, tmp_path):
    """A table of (vec_id, embedding), and DuckDB with the same table."""
    import duckdb

    def of(rows):
        spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<float>, label long").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
        c = duckdb.connect()
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        return str(tmp_path), c

    return of


def test_int8_uses_the_whole_scale(spark, vectors):
    """Quotients near a half, which a scale rounded to nine digits puts on its other side."""
    sf, c = vectors([(1, [0.24562455713748932, -0.35247817635536194]), (2, [0.19399969279766083, 0.2848319709300995]), (3, [0.0, 0.0]), (4, [63.5, -127.0, 62.5])])
    same(registry.QUERIES["int8_quantize"](spark, sf), c, registry.ORACLE_SQL["int8_quantize"])


def test_nearest_vectors_with_copies_ties_and_near_ties(spark, vectors, monkeypatch):
    """More copies than places, cosines that differ in the seventh digit only, products in several blocks; without a pair for pair join."""
    import numpy as np

    from corpusmill.operators import vectors as V

    monkeypatch.setattr(V, "BLOCK", 8)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 8))
    rows = []
    for i in range(1200):
        v = base[i % 40] + (rng.standard_normal(8) * 10.0 ** -(i % 7) if i % 3 else 0)
        rows.append((i, [float(x) for x in v.astype(np.float32)]))
    sf, c = vectors(rows)
    got = registry.QUERIES["cosine_topk"](spark, sf)
    assert "NestedLoop" not in got._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" in got._jdf.queryExecution().toString()
    same(got, c, registry.ORACLE_SQL["cosine_topk"])


def test_null_vectors_come_last(spark):
    from corpusmill.operators import vectors as V

    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0, 1.0]), (50, None)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in V.cosine_topk(v, v.where("vec_id % 50 = 0"), 2).collect())
    assert got == [(0, 1, None, 2), (0, 2, 0.707107, 1), (50, 0, None, 1), (50, 1, None, 2)]
    assert V.cosine_topk(v.limit(0), v.limit(0), 2).collect() == []
