"""Queries of page extraction and small models; where SQL has no equal, tests hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import models, ngrams, term_space, tools
from corpusmill.plans import golden
from corpusmill.plans.corpus_queries import numbered
from corpusmill.plans.registry import query, table
from corpusmill.sources import markup


@query()
def html_extract(spark, sf):
    """Title, text and links of each page."""
    read = markup.pages(table(spark, sf, "pages"))
    return read.select("page_id", "title", F.length("text").cast("long").alias("n_chars"), F.size("links").cast("long").alias("n_links"), F.md5("text").alias("text_md5"))


@query()
def term_vectors(spark, sf):
    """Random-indexing vectors of all phrases, by dimension."""
    return term_space.vectors(numbered(spark, sf))


@query()
def term_sketches(spark, sf):
    return term_space.sketches(numbered(spark, sf))


@query()
def subword_encode(spark, sf):
    """Documents by the sub-word vocabulary and single characters."""
    pieces = [r.gram for r in ngrams.subword_vocabulary(numbered(spark, sf)).collect()]  # 500
    ids = models.encoded(table(spark, sf, "documents"), pieces + [chr(c) for c in range(32, 127)])
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@query()
def count_min_sketch(spark, sf):
    """A count-min sketch of all search terms (about a kilobyte)."""
    terms = numbered(spark, sf).select(F.explode(T.terms("text")).alias("t"))
    return terms.agg(F.length(F.count_min_sketch("t", F.lit(0.01), F.lit(0.95), F.lit(7))).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n"))


@query()
def online_reranker(spark, sf):
    """Weights learned from labels, one model for each third of the documents."""
    rows = table(spark, sf, "labels").select((F.col("doc_id") % 3).alias("model"), "doc_id", (F.col("quality") + 0.0).alias("a"), F.lit(1.0).alias("b"), F.col("toxic").cast("double").alias("y"))
    return models.learn_online(rows, ["a", "b"], "y", "doc_id", [1.0, 1.0]).select("model", "n", F.array_join(F.transform("weights", lambda w: F.round(w, 6)).cast("array<string>"), ",").alias("weights"))


_SUMS = ["12×34は？", "1000円の10%は？", "2の10乗", "2024年は何年", "√16", "10割る4", "1/0", "hello", "3 + 4 * 2"]


@query()
def calculate(spark, sf):
    return golden.frame(spark, _SUMS, "id").select("id", "text", tools.calculated("text").alias("value"))



_ASKED = ["3日後は何日？", "10日前は？", "2週間後", "5か月後は", "14ヶ月後は？", "1年後は", "今何時？", "what time is it", "明日は？", "きのうは何曜日", "来週は？", "今日は何日？", "what is the date today", "今は?", "犬は動物"]
_JA = lambda d: f"year({d}) || '年' || month({d}) || '月' || day({d}) || '日（' || '{tools.WEEKDAYS}'[isodow({d})] || '曜日）'"
_DAY = lambda d: f"CASE WHEN regexp_matches(q, '[^\\x00-\\x7F]') THEN {_JA(d)} ELSE strftime({d}, '%Y-%m-%d (%a)') END"


@query(
    f"""WITH asked(k, q) AS (VALUES {', '.join(f"({i}, {golden.quoted(q)})" for i, q in enumerate(_ASKED))}),
a AS (SELECT o_orderkey AS id, q, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_orderdate AS DATE) AS d, TRY_CAST(regexp_extract(q, '{tools.SHIFT}', 1) AS INT) AS n, regexp_extract(q, '{tools.SHIFT}', 2) AS u FROM orders JOIN asked ON k = o_orderkey % {len(_ASKED)}),
s AS (SELECT *, CASE WHEN u = '日後' THEN CAST(d + to_days(n) AS DATE) WHEN u = '日前' THEN CAST(d - to_days(n) AS DATE) WHEN u = '週間後' THEN CAST(d + to_days(n * 7) AS DATE)
  WHEN u IN ('か月後', 'ヶ月後') THEN make_date(CAST(year(d) + (month(d) - 1 + n) // 12 AS INT), CAST((month(d) - 1 + n) % 12 + 1 AS INT), CAST(least(day(d), 28) AS INT))
  WHEN u = '年後' THEN TRY_CAST(printf('%04d-%02d-%02d', year(d) + n, month(d), day(d)) AS DATE) END AS e FROM a)
SELECT id, CASE WHEN NOT regexp_matches(q, '{tools.DATE_HINT}') THEN NULL WHEN n IS NOT NULL THEN n || u || 'は ' || {_DAY('e')} || ' です。'
  WHEN regexp_matches(q, '{tools.CLOCK}') THEN CASE WHEN regexp_matches(q, '[^\x00-\x7F]') THEN '今は ' || strftime(ts, '%H:%M') || ' です。' ELSE 'It is ' || strftime(ts, '%H:%M') || '.' END
  WHEN regexp_matches(q, '{tools.TOMORROW}') THEN '明日は ' || {_DAY('CAST(d + to_days(1) AS DATE)')} || ' です。'
  WHEN regexp_matches(q, '{tools.YESTERDAY}') THEN '昨日は ' || {_DAY('CAST(d - to_days(1) AS DATE)')} || ' でした。'
  WHEN regexp_matches(q, '{tools.NEXT_WEEK}') THEN '来週の今日は ' || {_DAY('CAST(d + to_days(7) AS DATE)')} || ' です。'
  WHEN regexp_matches(q, '{tools.TODAY}') THEN CASE WHEN regexp_matches(q, '[^\x00-\x7F]') THEN '今日は ' || {_DAY('d')} || ' です。' ELSE 'Today is ' || {_DAY('d')} || '.' END END AS answer FROM s"""
)
def date_answers(spark, sf):
    """Questions about dates, each asked on the day of an order."""
    asked = F.array(*map(F.lit, _ASKED))
    q = F.element_at(asked, (F.col("o_orderkey") % len(_ASKED)).cast("int") + 1)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), tools.date_answer(q, F.col("o_orderdate").cast("timestamp")).alias("answer"))
