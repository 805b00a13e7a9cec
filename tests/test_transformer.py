"""The decoder: gradients against differences, growth, cached decoding, training over partitions, files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import transformer as M

SHAPE = M.Shape(vocabulary=11, width=8, layers=2, heads=2, hidden=12)


def doubles(w, scale=10):
    return {n: t.astype(float) * (scale if t.ndim > 1 else 1) for n, t in w.items()}


@pytest.fixture(scope="module")
def ids():
    return np.random.default_rng(3).integers(0, 11, (3, 7))


def test_gradients_equal_differences(ids):
    w = doubles(M.fresh(SHAPE))
    weights = np.random.default_rng(4).uniform(-1, 1, (3, 6))
    _, grads = M.loss_and_gradients(w, ids, weights, SHAPE.heads)
    rng = np.random.default_rng(5)
    for n, t in w.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in t.shape)
            old, h = t[at], 1e-5
            t[at] = old + h
            more = M.loss_and_gradients(w, ids, weights, SHAPE.heads)[0]
            t[at] = old - h
            less = M.loss_and_gradients(w, ids, weights, SHAPE.heads)[0]
            t[at] = old
            assert abs((more - less) / (2 * h) - grads[n][at]) < 1e-5, n


def test_growth_changes_nothing(ids):
    w = M.fresh(SHAPE)
    before = M.forward(w, ids, 2)[0]
    assert np.allclose(before, M.forward(M.deeper(w, SHAPE), ids, 2)[0], atol=1e-6)
    assert np.allclose(before, M.forward(M.broader(w, 4), ids, 2)[0], atol=1e-6)
    assert np.allclose(before, M.forward(M.more_tokens(w, [[1, 2], []]), ids, 2)[0][..., :11], atol=1e-6)


def test_cached_decoding_equals_whole(ids):
    w = doubles(M.fresh(SHAPE))
    past = [None] * SHAPE.layers
    parts = [M.forward(w, ids[:, a:b], 2, past)[0] for a, b in ((0, 3), (3, 4), (4, 7))]
    assert np.allclose(np.concatenate(parts, 1), M.forward(w, ids, 2)[0], atol=1e-9)


def test_choice_keeps_its_rules():
    rng = np.random.default_rng(0)
    logits = np.array([1.0, 3.0, 2.9, 0.0])
    assert M.choose(logits, [], set(), rng, 0, 1, 1, 0, 3) == 1
    assert M.choose(logits, [1], set(), rng, 0, 1, 1.5, 0, 3) == 2
    assert M.choose(logits, [], {3}, rng, 0, 1, 1, 5, 3) == 3
    assert M.choose(logits, [0, 3, 1, 0, 3], set(), rng, 0, 1, 1, 0, 3) == 2


def test_training_learns_and_files_keep_it(spark, tmp_path):
    rows = spark.range(240).select("id", F.array(*[((F.col("id") + i) % 6 + 4).cast("int") for i in range(8)]).alias("ids"), F.lit(1.0).alias("weight"), F.lit(0).alias("loss_from"))
    w = M.fresh(SHAPE)
    mean = lambda w: M.scored(rows, w, SHAPE).agg(F.avg("nats")).first()[0]
    first = mean(w)
    trained = M.train(rows, w, SHAPE, rounds=4, workers=2, rate=0.02)
    assert mean(trained) < 0.6 * first
    M.save(spark, trained, SHAPE, str(tmp_path / "model"))
    again, shape = M.load(spark, str(tmp_path / "model"))
    assert shape == SHAPE and all(np.array_equal(trained[n], again[n]) for n in trained)
    prompts = spark.createDataFrame([(1, [4, 5, 6]), (2, [9]), (3, [])], "id long, ids array<int>")
    got = {r.id: r.ids for r in M.continued(prompts, trained, SHAPE, new=3, end=2, temperature=0, penalty=1.0).collect()}
    assert got[1] == [7, 8, 9] and got[2] == [4, 5, 6] and got[3] == []
    empty = M.train(rows.limit(0), w, SHAPE, rounds=1)
    assert all(np.array_equal(empty[n], w[n]) for n in w)
