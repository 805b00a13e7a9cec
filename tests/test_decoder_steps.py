"""A batch is learned in one pass, the optimiser moves all tensors at once, and prompts are continued together; as if one by one."""

from __future__ import annotations

import numpy as np

from corpusmill.operators import transformer as M

SHAPE = M.Shape(vocabulary=13, width=16, layers=2, heads=2, hidden=8)


def test_a_batch_is_one_pass_and_equals_its_rows(monkeypatch):
    rng, calls, forward = np.random.default_rng(6), [], M.forward
    w = {n: t.astype(float) * (10 if t.ndim > 1 else rng.uniform(0.5, 1.5, t.shape)) for n, t in M.fresh(SHAPE).items()}
    ids, weights = rng.integers(0, 13, (16, 40)), rng.uniform(-1, 1, (16, 39))
    monkeypatch.setattr(M, "forward", lambda *a: calls.append(1) or forward(*a))
    loss, grads = M.loss_and_gradients(w, ids, weights, SHAPE.heads)
    assert len(calls) == 1
    shares = np.abs(weights).sum(1) / np.abs(weights).sum()
    rows = [M.loss_and_gradients(w, ids[i : i + 1], weights[i : i + 1], SHAPE.heads) for i in range(16)]
    assert abs(loss - sum(s * r[0] for s, r in zip(shares, rows, strict=True))) < 1e-9
    for n, g in grads.items():
        assert np.allclose(g, sum(s * r[1][n] for s, r in zip(shares, rows, strict=True)), atol=1e-10), n


def test_the_optimiser_moves_one_array_as_it_would_each_tensor():
    rng, w = np.random.default_rng(7), M.fresh(SHAPE)
    state, plain = M.Optimiser(w), {n: [t.astype(float), 0, 0] for n, t in w.items()}
    average = {n: t.astype(float) for n, t in w.items()}
    for step in range(1, 10):
        grads = {n: rng.standard_normal(w[n].shape).astype(np.float32) for n in reversed(list(w))}
        state.update(grads, 0.01)
        scale = min(1, M.CLIP / np.sqrt(sum((g.astype(float) ** 2).sum() for g in grads.values())))
        for n, (t, m, v) in plain.items():
            m, v = M.BETA1 * m + (1 - M.BETA1) * grads[n] * scale, M.BETA2 * v + (1 - M.BETA2) * (grads[n] * scale) ** 2
            move = m / (1 - M.BETA1**step) / (np.sqrt(v / (1 - M.BETA2**step)) + 1e-8)
            plain[n] = [t - 0.01 * (move + (M.DECAY * t if t.ndim > 1 else 0)), m, v]
        if step % M.AVERAGE_EVERY == 0:
            average = {n: M.KEEP * t + (1 - M.KEEP) * plain[n][0] for n, t in average.items()}
    assert all(t.base is state.w["embedding"].base is not None for t in state.w.values())
    assert all(np.allclose(state.w[n], plain[n][0], atol=1e-5) for n in w)
    assert all(np.allclose(state.average[n], average[n], atol=1e-5) for n in w)


def test_prompts_are_continued_together(monkeypatch):
    rng, steps, forward = np.random.default_rng(8), [], M.forward
    w = {n: t.astype(float) * (10 if t.ndim > 1 else 1) for n, t in M.fresh(SHAPE, 3).items()}
    prompts = [list(rng.integers(0, 13, n)) for n in (5, 1, 40, 17, 64, 5)]
    monkeypatch.setattr(M, "forward", lambda *a: steps.append(a[1].shape) or forward(*a))
    seen = {}

    def pick(i, logits, ids):
        seen[i, len(ids)] = (list(ids), np.array(logits))
        return int(logits[:12].argmax()) if (i, len(ids)) != (3, 19) else 12

    got = M._continue(w, SHAPE.heads, prompts, pick, 6, 12)
    assert len(steps) == len(prompts) + 5 and steps[-1] == (6, 1)
    for ids, logits in seen.values():
        assert np.allclose(logits, forward(w, np.array([ids]), SHAPE.heads)[0][0, -1], atol=1e-9)
    assert len(got[3]) == 2 and 12 not in sum(got, []) and all(len(t) <= 6 for t in got)
