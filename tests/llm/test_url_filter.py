from __future__ import annotations

import random

import pytest

from corpusmill.llm import url_filter
from corpusmill.llm.queries import ORACLE_SQL, QUERIES, URL_RULES


def brute(url, rules):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/7?x", "https://a.example.com/en/6#t", "http://example.net/de/8/", "http://x.example.net/de/9", "http://net/de/", "ftp://notnet/de/1",
    "http://ÉX.org/es/", "http://example.org?/es/", "http://example.org#/es/", "http://com/en", "http://com/en/", "http://example.com/en/7" + "7" * 5000, "://org/es/1", "a://b://org/es/", "http://.org/es/", "http://org./es/",
]


@pytest.mark.parametrize("most_bits", [url_filter.MOST_BITS, 256])
def test_rules_against_brute_force(spark, monkeypatch, most_bits):
    """Also with a list cut into several parts, each with its own cascades."""
    monkeypatch.setattr(url_filter, "MOST_BITS", most_bits)
    rng = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org"]
    rules = {(h, p): (v, h, p) for v, h, p in URL_RULES + [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(["", "/", "/a", "/ab", "/b/"])) for _ in range(15)]}
    rules = list(rules.values())
    urls = URLS + [f"http://{rng.choice(['', 'w.', 'a.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/abc', '/b/c', '?q'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, size long")
    got = url_filter.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_query_against_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(tuple, QUERIES["op1_url_filter"](spark, sf).collect())) == sorted(c.execute(ORACLE_SQL["op1_url_filter"]).fetchall())


def test_cascade_is_exact_over_the_universe(spark):
    """With a first level that is far too small, so that several levels alternate."""
    universe = spark.range(3000).selectExpr("concat('k', id) AS key")
    listed = universe.where("hash(key) % 3 = 0")
    cascade = url_filter.Cascade.build(listed, universe)
    assert len(cascade.levels) >= 3
    wrong = universe.join(listed.selectExpr("key", "true AS l"), "key", "left").where(cascade.has(universe["key"]) != url_filter.F.coalesce("l", url_filter.F.lit(False)))
    assert wrong.count() == 0


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(pages, rules).collect()] == [(1, "a", "/b", None, "allow")]
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(URL_RULES, "verdict string, host string, path string")).collect() == []


@pytest.mark.parametrize("turn", [1, -1])
def test_rule_ties_and_odd_rules(spark, turn):
    """Block wins, in whatever order the rules come; rules without a host or with another verdict fit nothing."""
    rules = [("block", "a.com", "/x"), ("allow", "a.com", "/x"), ("allow", None, "/"), ("maybe", "b.com", "/"), (None, "b.com", ""), ("block", "c.com", None)][::turn]
    pages = [(1, "http://a.com/xy"), (2, "http://b.com/"), (1, "http://a.com/xy"), (3, "http://w.C.com")]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    assert sorted(((r.page_id, r.rule, r.verdict) for r in got), key=str) == [(1, "a.com/x", "block"), (1, "a.com/x", "block"), (2, None, "allow"), (3, "c.com", "block")]


def test_no_join_with_the_urls(spark, sf):
    """The judging plan has no join and no shuffle, however long the list."""
    rules = spark.range(3000).selectExpr("if(id % 2 = 0, 'block', 'allow') AS verdict", "concat('h', id, '.com') AS host", "'/' AS path")
    plan = url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet"), rules)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
