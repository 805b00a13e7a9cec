"""Golden cases of the text functions."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import corpus, dialogs, facts, models, ngrams, tools
from corpusmill.plans import fact_queries, golden


def value(spark, column, *texts):
    names = [f"t{i}" for i in range(len(texts))]
    return spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first().v


def test_tokens(spark):
    assert value(spark, T.tokenize("t0"), "人工知能 is AI!") == ["人", "工", "知", "能", "is", "ai", "!"]
    assert value(spark, T.detokenize(T.tokenize("t0")), "hello world !") == "hello world!"


def test_sentences(spark):
    assert value(spark, T.split_sentences(T.normalize(T.nfkc("t0"))), "今日は晴れ。明日は雨です！行きますか？") == ["今日は晴れ。", "明日は雨です!", "行きますか?"]
    assert len(value(spark, T.split_sentences("t0"), "彼は「行くよ。」と言った。Mr. Smith left. He came back.")) == 3
    assert value(spark, T.split_sentences("t0"), "これは文です。\n」続きです") == ["これは文です。」続きです"]
    assert value(spark, T.split_sentences("t0"), "") == []


def test_terms_and_phrases(spark):
    assert {"人工", "人工知能"} <= set(value(spark, T.terms("t0"), "人工知能とは"))
    assert value(spark, T.terms("t0"), "é ü") == ["é", "ü"]
    assert value(spark, T.phrases("t0"), "機械学習とは、データから規則性を学ぶ手法である。Python is great") == ["機械学習", "データ", "規則性", "手法", "python", "great"]
    assert value(spark, T.keywords("t0"), "東京タワーの高さは？")[0] == "東京タワー"
    for text, want in (("機械学習", True), ("python", True), ("習に", False), ("the", False)):
        assert value(spark, T.is_phrase(F.col("t0")), text) is want


@pytest.mark.parametrize("text", ["| a | b | c | d |", "1990 2000 2010 2020 2030", "a" * 26])
def test_junk(spark, text):
    assert value(spark, T.is_junk("t0"), text)


def test_near_duplicates(spark):
    rows = ["東京タワーの高さは 333 メートルである。", "東京タワーの高さは 333 メートルである！", "333 メートルである、東京タワーの高さは。", "東京タワーの高さは 333 メートルである (公式) である。"]
    df = spark.createDataFrame([(i, 0, f"s{i}", t) for i, t in enumerate(rows)], "doc_id long, pos long, source string, text string")
    admitted = corpus.admit(corpus.numbered(df))
    assert {r.seq // corpus.PER_DOCUMENT: r.status for r in admitted.collect()} == {0: "kept", 1: "duplicate", 2: "duplicate", 3: "kept"}
    score = {r.seq // corpus.PER_DOCUMENT: (r.sources, r.score) for r in corpus.corroborated(admitted).collect()}
    assert score == {0: (3, 1.0), 3: (1, 0.0)}


@pytest.mark.parametrize(("text", "kind"), [("富士山の高さは？", "howmany"), ("日本の首都はどこ？", "where"), ("いつ設立された？", "when"), ("機械学習とは？", "definition"), ("今日は晴れです。", "none")])
def test_question_types(spark, text, kind):
    assert value(spark, T.question_type("t0"), text) == kind


def test_key_match(spark):
    assert value(spark, T.key_match(F.col("t0"), F.col("t1")), "ヴォルフガング・パウリ", "パウリの原理")
    assert not value(spark, T.key_match(F.col("t0"), F.col("t1")), "カレー", "レーの話")


def test_replies(spark):
    assert value(spark, T.clean_reply("t0"), "以下のような点に注意してください。\n- 温度の管理をする\n- 湿度の管理をする") == "以下のような点に注意してください。 温度の管理をする 湿度の管理をする"
    long = "一文目です。" * 60
    assert len(value(spark, T.shorten("t0", 220), long)) <= 260
    assert value(spark, T.term_overuse("t0"), "犬と犬と犬と犬と猫") > 0
    assert value(spark, T.repeat_ratio("t0"), "今日は、今日は、今日は、今日は、") > 0.4


def test_spans_against_a_loop(spark):
    texts = {d: [f"sentence {d} {i} " + "x" * (i * 37 % 140) for i in range(20)] for d in range(5)}
    df = spark.createDataFrame([(d, i, t) for d, ts in texts.items() for i, t in enumerate(ts)], "doc_id long, pos long, text string")
    want = []
    for d, ts in texts.items():
        done, now = [], ""
        for t in ts:
            now += t
            if len(now) >= 350:
                done.append(now)
                now = ""
        if len(now) >= 40:
            done.append(now)
        want += [(d, i, s) for i, s in enumerate(done)]
    assert sorted(map(tuple, corpus.spans(df).collect())) == sorted(want)


def test_running_sum_over_blocks(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS v")
    got = {r.id: r.s for r in corpus.running_sum(df, F.floor(F.col("id") / 64), ["id"], F.col("v"), "s").collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert got[i] == total


FACTS = [
    ("東京タワーの高さは333メートルである。", ("東京タワー", "高さ", "333メートル")),
    ("東京タワーは港区に位置する。", ("東京タワー", "location", "港区")),
    ("機械学習とは、データから規則性を学ぶ手法である。", ("機械学習", "definition", "データから規則性を学ぶ手法")),
    ("日本の首都は東京である。", ("日本", "首都", "東京")),
    ("ニュートンは1687年に万有引力の法則を公開した。", None),
    ("Python is a programming language.", ("Python", "definition", "programming language")),
    ("The capital of France is Paris.", ("France", "capital", "Paris")),
    ("これは本である。", None),
    ("short", None),
]


@pytest.mark.parametrize(("text", "want"), FACTS)
def test_facts(spark, text, want):
    got = value(spark, facts.extract(F.col("t0")), text)
    if want is None and text.startswith("ニュートン"):
        assert got is None or got.relation in ("event", "is")
    else:
        assert (None if got is None else tuple(got)) == want


def test_answers(spark, sf):
    got = {r.id: r.answer for r in fact_queries.fact_answers(spark, sf).collect()}
    first = golden.FIRST_ID
    assert "333" in got[first] and "300" in got[first]
    assert "東京" in got[first + 1] and "規則性" in got[first + 3] and "Paris" in got[first + 5]
    assert first + 7 not in got  # an honest unknown
    chain = {r.id: r.answer for r in fact_queries.fact_multihop(spark, sf).collect()}
    assert "270" in chain[1]
    parsed = value(spark, facts.parse_question(F.col("t0")), "アルファ社の本社の人口は？")
    assert tuple(parsed) == ("アルファ社の本社", "人口")


@pytest.mark.parametrize(("text", "want"), [("12×34は？", 408), ("1000円の10%は？", 100), ("2の10乗", 1024), ("2024年は何年", None), ("1/0", None), ("√16", 4), ("2**5000", None), ("9の平方根", 3), ("-3+5*2", 7), ("(1+2)*3-4/8", 8.5), ("７×６", 42), ("7%4+1", 4)])
def test_calculations(text, want):
    assert tools.calculate(text) == want


def test_formulas_against_python():
    """Random formulas, whose values Python's own grammar gives."""
    import math
    import random

    rng = random.Random(4)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.25:
            return rng.choice([str(rng.randint(0, 9)), f"{rng.randint(0, 9)}.{rng.randint(0, 9)}", "pi", "e"])
        if kind < 0.35:
            return rng.choice("+-") + made(depth - 1)
        if kind < 0.5:
            return f"({made(depth - 1)})"
        if kind < 0.6:
            return f"{rng.choice(['sqrt', 'abs', 'floor', 'ceil', 'round', 'cos'])}({made(depth - 1)})"
        return made(depth - 1) + rng.choice([" + ", "-", "*", "/", "//", "%", "**"]) + made(depth - 1)

    def outcome(f):
        try:
            x = f()
            return None if isinstance(x, complex) else x
        except (ValueError, ZeroDivisionError, OverflowError, TypeError):
            return None

    seen = 0
    for _ in range(3000):
        formula = made(4)
        want = outcome(lambda: eval(formula, {"__builtins__": {}}, {**tools.FUNCTIONS, **tools.CONSTANTS}))  # noqa: B023, S307
        got = outcome(lambda: tools.value_of(formula))  # noqa: B023
        if got is None and want is not None:
            assert "**" in formula  # exponents have a limit
            continue
        assert got == want or (want is not None and math.isnan(want)), formula
        seen += want is not None
    assert seen > 1000
    for broken in ("", "1+", "(1", "1)", "1 2", "foo(1)", "__import__", "1,2", "sqrt", "()", "sqrt()"):
        with pytest.raises((ValueError, TypeError)):
            tools.value_of(broken)


def test_nfkc(spark):
    for t in ("ＡＢＣ　１", "ﾃｽﾄ", "①", "plain", None):
        assert value(spark, T.nfkc("t0"), t) == (None if t is None else unicodedata.normalize("NFKC", t))


def test_banned_tokens_and_weights(spark):
    row = spark.sql("SELECT array(5, 6, 7, 5, 6) AS a")
    assert row.select(dialogs.banned_next(F.col("a"), 3).alias("v")).first().v == [7]
    assert row.select(dialogs.token_weights(F.lit(4), F.lit(3), F.lit(1.0)).alias("v")).first().v == [0.2, 0.2, 1.0, 1.0]


def test_continuations(spark):
    rows = spark.createDataFrame([("a b c d e",), ("a b c d f",), ("x b c y",)], "text string")
    asked = spark.createDataFrame([(1, "q a b c d"), (2, "b c"), (3, "z w")], "id long, text string")
    got = {(r.id, r.next): (r.length, r.n) for r in ngrams.longest_continuations(asked, rows).collect()}
    assert got == {(1, "e"): (4, 1), (1, "f"): (4, 1), (2, "d"): (2, 2), (2, "y"): (2, 1)}


def test_dialog_formats(spark, sf):
    from corpusmill.plans import dialog_queries

    got = sorted((r.kind, r.user, r.bot, r.context, r.weight) for r in dialog_queries.dialog_formats(spark, sf).collect())
    assert got == sorted([
        ("instruction", "訳して\nhello", "こんにちは", None, 1.0),
        ("qa", "Q", "A.", None, 1.0),
        ("qa_text", "Q", "A", None, 1.0),
        ("wikiqa", "首都は", "東京。", "日本の首都は東京である。", 1.0),
        ("squad", "Where?", "Paris。", "It is in Paris now.", 1.0),
        ("preference", "hi", "hello", None, 1.0),
        ("preference", "hi", "go away", None, -1.0),
    ])
    said = {(r.doc_id, r.user, r.bot) for r in dialog_queries.quote_pairs(spark, sf).collect()}
    assert (golden.FIRST_ID, "行くのか", "行くよ") in said and not any(d == golden.FIRST_ID + 2 for d, _, _ in said)


def test_dialog_store(spark):
    rows = [("a b", "Write to me at x@y.org please"), ("same", "reply one"), ("same", "reply one"), ("long", "以下のような質問があります。"), ("ok?", "**Fine** then.")]
    df = spark.createDataFrame([(i, 0, u, b) for i, (u, b) in enumerate(rows)], "conv_id long, turn long, user string, bot string")
    assert sorted((r.user, r.bot) for r in dialogs.admitted(df).collect()) == [("ok?", "Fine then."), ("same", "reply one")]


def test_index_vectors_are_stable(spark):
    entries = models.index_entries("term")
    assert len(entries) == 8 and all(0 <= d < 128 and s in (1, -1) for d, s in entries) and entries == models.index_entries("term")
    assert len(models.planes()) == 64 and all(len(p) == len(m) == 16 and not set(p) & set(m) for p, m in models.planes())
    pairs = spark.createDataFrame([("a", "b", 2), ("a", "c", 1)], "term string, neighbour string, weight int")
    want = {}
    for n, w in (("b", 2), ("c", 1)):
        for d, s in models.index_entries(n):
            want[d] = want.get(d, 0) + s * w
    assert {r.dim: r.x for r in models.term_vectors(pairs).collect()} == want


def test_encoding_is_greedy():
    assert models.encode("abcab?", {"a": 1, "ab": 2, "abc": 3, "b": 4}, 3) == [3, 2, 0]


def test_expectations(spark, sf):
    from corpusmill.plans import judging_queries

    assert {r.id: r.ok for r in judging_queries.expectation_judge(spark, sf).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: False}
    said = {r.id: r.text for r in judging_queries.reply_format(spark, sf).collect()}
    assert said == {1: "・一文目です。\n・二文目です。", 2: "一文目です。", 3: "これは長い文です…", 4: "そのままです。"}
    got = {r.id: r.winner for r in judging_queries.compare_by_fact(spark, sf).collect()}
    assert got == {2: "東京"}
