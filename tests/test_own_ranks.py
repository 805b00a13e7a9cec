"""Ranks of own sentences: those of the whole search, whatever the size of blocks; little is written for them."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import corpus, ranks, search
from corpusmill.plans import retrieval_queries as q
from corpusmill.plans.corpus_queries import admitted, numbered


def written(spark) -> int:
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize(("block", "pairs"), [(1 << 17, 1 << 18), (7, 5)])
def test_ranks_equal_those_of_the_whole_search(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(ranks, "BLOCK", block)
    monkeypatch.setattr(ranks, "PAIRS", pairs)
    rng = random.Random(4)
    words = [f"w{i}x" for i in range(30)] + ["the", "of", "東京タワー", "大阪", "か"]
    rows = [(i, rng.choice([0.4, 0.55, 0.9]), " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 9])))) for i in range(150)]
    rows += [(200 + i, 0.55, "alpha beta gamma delta epsilon") for i in range(14)]  # more equal ones than are ranked
    rows += [(300, 0.5, "3abc 4def 9ghi"), (301, 0.5, ""), (302, 0.5, "--"), (303, 0.7, "alpha " * 300)]
    docs = spark.createDataFrame(rows, "seq long, quality double, text string")
    ask = F.when(F.col("seq") % 2 == 0, search.pseudo_query(F.col("text")))
    made = docs.select("seq", ask.alias("text")).where("text is not null").select(F.col("seq").alias("id"), "text")
    hits = search.bm25(docs, made, 10).where("id = seq").select("id", "rank")
    got = ranks.own_ranks(docs.select("seq", "quality", T.terms("text").alias("t"), ask.alias("ask")), 10).select("id", "rank")
    wanted = {r.id: r.rank for r in hits.collect()}
    assert {r.id: r.rank for r in got.collect()} == wanted and 212 not in wanted and 300 not in wanted and len(wanted) > 50


def test_first_kept_are_those_of_admission(spark, sf):
    got = corpus.first_kept(numbered(spark, sf), 0.4, text=F.col("text"))
    kept = admitted(spark, sf).where("status = 'kept'").select("seq", "quality", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kept.collect()))


def test_no_postings_are_exchanged(spark):
    sf = "/root/testdata/sf0.01"
    before = written(spark)
    assert q.retrieval_mrr(spark, sf).count() == 1
    assert written(spark) - before < 5 * Path(sf, "documents.parquet").stat().st_size
