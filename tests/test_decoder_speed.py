"""The decoder leaves out scores that no query reads, and scores sequences together; results are those of plain sums."""

from __future__ import annotations

import numpy as np
import pytest

from corpusmill.operators import transformer as M

SHAPE = M.Shape(vocabulary=13, width=16, layers=2, heads=2, hidden=8)


def model(scale):
    return {n: t.astype(float) * (scale if t.ndim > 1 else 1) for n, t in M.fresh(SHAPE).items()}


@pytest.mark.parametrize(("scale", "n"), [(1, 127), (60, 70), (10, 33), (10, 1)])
def test_attention_equals_plain_sums_over_half_the_scores(scale, n):
    rng = np.random.default_rng(0)
    q, k, v = (rng.standard_normal((2, 2, n, 8)) * f for f in (scale, 1, 1))
    sums, blocks = M._attend(q, k, np.concatenate([v, np.ones_like(v[..., :1])], -1), 0)
    p = M._softmax(q @ k.transpose(0, 1, 3, 2) + np.triu(np.full((n, n), -1e9), 1))
    assert np.allclose(sums[..., :-1] / sums[..., -1:], p @ v, atol=1e-9)
    if n == 127:
        assert sum(e.size for e in blocks) < 0.65 * p.size


def test_gradients_of_whole_windows_equal_differences():
    rng = np.random.default_rng(1)
    w, ids, weights = model(10), rng.integers(0, 13, (9, 70)), rng.uniform(-1, 1, (9, 69))
    _, grads = M.loss_and_gradients(w, ids, weights, SHAPE.heads)
    for n, t in w.items():
        at = tuple(rng.integers(0, s) for s in t.shape)
        old, h, ends = t[at], 1e-5, []
        for t[at] in (old + h, old - h):
            ends.append(M.loss_and_gradients(w, ids, weights, SHAPE.heads)[0])
        t[at] = old
        assert abs((ends[0] - ends[1]) / (2 * h) - grads[n][at]) < 1e-5, n


def test_sequences_are_scored_together(monkeypatch):
    rng, w, calls, forward = np.random.default_rng(2), model(10), [], M.forward
    rows = [rng.integers(0, 13, n) for n in (5, 40, 0, 2, 1, 33, 40, 7, 3, 64, 12)]
    monkeypatch.setattr(M, "forward", lambda *a: calls.append(1) or forward(*a))
    tokens, nats = M._nats(w, SHAPE.heads, rows)
    assert list(tokens) == [max(len(t) - 1, 0) for t in rows] and len(calls) == 2
    for t, got in zip(rows, nats, strict=True):
        if len(t) < 2:
            assert np.isnan(got)
            continue
        p = M._softmax(forward(w, t[None, :-1], SHAPE.heads)[0])[0]
        assert abs(got + np.log(p[np.arange(len(t) - 1), t[1:]]).mean()) < 1e-9
