"""Both models of decoder_training score a window where it is read once; each as it would alone."""

from __future__ import annotations

import numpy as np

from corpusmill.operators import transformer as M
from corpusmill.plans import training_queries as q


def test_both_models_score_in_one_pass(spark, sf, monkeypatch):
    made = {}

    def train(rows, w, shape, rounds):
        made.update(rows=rows, start=w, shape=shape, end={n: t * np.float32(5 if t.ndim > 1 else 1) for n, t in w.items()})
        return made["end"]

    monkeypatch.setattr(q.transformer, "train", train)
    df = q.decoder_training(spark, sf)
    assert df.columns == ["id", "held", "tokens", "before", "after"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    got = {r.id: r for r in df.collect()}
    rows = q._dialog_ids(spark, sf)[0]
    for name, w in (("before", made["start"]), ("after", made["end"])):
        sums = {}
        for r in M.scored(rows, w, made["shape"]).collect():
            nats, tokens = sums.get(r.id, (0, 0))
            sums[r.id] = (nats + r.nats * r.tokens, tokens + r.tokens)
        assert set(sums) == set(got)
        assert all(abs(got[i][name] - nats / n) < 1e-4 and got[i].tokens == n for i, (nats, n) in sums.items())
    assert {r.held for r in got.values()} <= {True, False}
