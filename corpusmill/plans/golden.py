"""Small texts in Japanese and English that join the driver's tables, which have no CJK characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST_ID = 10_000_000

#: Sentences of a small encyclopaedia.
TEXTS = [
    "東京タワーとは、日本の東京都港区にある電波塔である。",
    "東京タワーの高さは333メートルである。東京タワーは港区に位置する。",
    "東京タワーの高さは300メートルである。",
    "機械学習とは、データから規則性を学ぶ手法である。",
    "日本の首都は東京である。東京の人口は1400万人である。",
    "アルファ社の本社はベータ市である。ベータ市の人口は270万人である。",
    "人工知能 is AI! Python is a programming language.",
    "今日は晴れ。明日は雨です！行きますか？",
    "彼は「行くよ。」と言った。Mr. Smith left. He came back.",
    "富士山の標高は3776メートルである。富士山は日本にある。",
    "分類の手法には決定木、サポートベクターマシン、ニューラルネットワークなどがある。",
    "The capital of France is Paris. Paris is a city in Europe. The height of the tower is 330 m.",
    "Python was created in 1991. Python's author is Guido van Rossum. The Eiffel Tower is a tower in Paris.",
    "犬と猫はどちらも動物です。犬、犬、犬、犬は動物、猫は動物、犬は動物である。",
    "| a | b | c | d |",
    "1990 2000 2010 2020 2030",
    "aaaaaaaaaaaaaaaaaaaaaaaaaa",
    "東京タワーの高さは 333 メートルである！",
    "333 メートルである、東京タワーの高さは。",
    "味噌汁の作り方は、だしを取り味噌を溶くことである。",
    "ニュートンは1687年に万有引力の法則を公開した。",
    "ア社は1937年に設立された。ア社の社長は佐藤である。",
]
#: Questions about them.
QUESTIONS = [
    "東京タワーの高さは？",
    "日本の首都はどこ？",
    "ア社はいつ設立された？",
    "機械学習とは？",
    "アルファ社の本社の人口は？",
    "What is the capital of France?",
    "what is Python?",
    "富士山の面積は？",
    "今日は晴れです。",
    "東京タワーはどこ？",
    "こんにちは、元気ですか",
    "tell me more",
    "それで?",
]


def rows(texts: list[str]) -> list[tuple[int, str]]:
    return [(FIRST_ID + i, t) for i, t in enumerate(texts)]


def frame(spark: SparkSession, texts: list[str], id_col: str = "doc_id") -> DataFrame:
    return spark.createDataFrame(rows(texts), f"{id_col} long, text string")


def values(texts: list[str]) -> str:
    """As a DuckDB VALUES list of (id, text)."""
    return "VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {quoted(t)})" for i, t in rows(texts))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
