"""Whole pairs are learned: their windows hold each id once, and only the last one ends."""

from __future__ import annotations

from corpusmill.operators import dialogs
from corpusmill.plans import training_queries as q
from corpusmill.plans.registry import table


def test_windows_hold_whole_pairs(spark, sf):
    rows, pieces = q._dialog_ids(spark, sf)
    said = {i + len(q._SPECIAL): p for i, p in enumerate(pieces)}
    got = {}
    for r in rows.orderBy("id", "at").collect():
        assert len(r.ids) <= q.WIDTH and r.loss_from == max(0, len(r.head) - r.at)
        own = got.setdefault(r.id, [])
        assert not own or own[-1] == r.ids[0]
        own.extend(r.ids[1:] if own else r.ids)
    pairs = dialogs.pairs(table(spark, sf, "conversations")).collect()
    assert len(got) == len(pairs)
    for p in pairs:
        ids = got[p.conv_id * 1000 + p.turn]
        assert ids.count(q._SPECIAL["eos"]) == 1 and ids[-1] == q._SPECIAL["eos"]
        known = "".join(c for c in (p.user + p.bot).lower() if c in set(pieces))
        assert "".join(said.get(i, "") for i in ids) == known
