from __future__ import annotations

import hashlib
import random
import re

import pytest

from corpusmill.llm import decontaminate
from corpusmill.llm.queries import ORACLE_SQL, QUERIES

from .conftest import ODD


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, length=10):
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, u in items:
            v = words(u)
            n = min(length, len(v))
            windows = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


@pytest.mark.parametrize("limit", [20_000, 0])
def test_against_brute_force(spark, make, limit):
    """Also by the joined way, that takes over from the literal set."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ünï", "don't"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 6, 9, 10, 11, 25])))) for i in range(40)] + [(100, None), (101, ""), (102, " - "), (7, "dup")]
    docs = [*ODD[:6], *((100 + i, ", ".join(rng.choices(vocabulary, k=rng.randint(0, 60))).upper()) for i in range(60))]
    docs += [(200 + i, f"pre {items[i][1]}. post {items[i + 1][1]}") for i in range(20)]
    docs = list({i: (i, t) for i, t in docs}.values())
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate.contamination(make(docs), bench, literal_limit=limit)) == brute(docs, items)


@pytest.mark.parametrize("limit", [20_000, 0])
def test_rows_that_share_an_id_are_judged_each(spark, make, limit):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = make([(1, "a b c x"), (1, "zz yy"), (2, "q"), (1, None)])
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, bench, literal_limit=limit).collect())
    assert got == [(1, 0, 0, False), (1, 2, 0, False), (1, 4, 3, True), (2, 1, 0, False)]
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, ""), (1, "zz yy"), (2, "q")]


def test_a_long_text_that_is_all_benchmark(spark, make):
    import time

    text = " ".join(f"w{i * 7919 % 15_000}" for i in range(15_000))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    t = time.time()
    assert [r.n_hit for r in decontaminate.contamination(make([(1, text)]), bench).collect()] == [15_000]
    assert time.time() - t < 60


def test_empty_tables(spark, make):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.contamination(make([(1, "a"), (2, None)]), bench).collect()} == {1: False, 2: False}
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(make([(1, "a")]).limit(0), some).collect() == []
    assert [r.doc_id for r in decontaminate.keep_clean(make([(1, "x a b c"), (2, "a b")]), some).collect()] == [2]


def test_query_against_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.execute(ORACLE_SQL["op9_decontaminate"]).fetchall()
    assert rows(QUERIES["op9_decontaminate"](spark, sf)) == {r[0]: r[1:] for r in want}
