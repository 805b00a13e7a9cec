"""Queries of polite requests, source plans, doubts, budgets, thresholds and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import control, dialogs, facts, search
from corpusmill.operators.store import stored
from corpusmill.plans import golden
from corpusmill.plans.corpus_queries import ADMITTED, kept
from corpusmill.plans.dialog_queries import PAIRS
from corpusmill.plans.registry import query, table
from corpusmill.sources import web


@query(
    "WITH e AS (SELECT event_id, user_id, epoch(ts)::DOUBLE AS asked, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) "
    "SELECT event_id, round(max(asked - 2 * n) OVER (PARTITION BY user_id ORDER BY n) + 2 * n, 3) AS starts FROM e"
)
def polite_requests(spark, sf):
    """Events as requests, users as hosts: when each may start with two seconds between a host's requests."""
    rows = table(spark, sf, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("asked"))
    return rows.select("event_id", F.round(web.polite_start(F.col("asked"), "user_id", ["asked", "event_id"]), 3).alias("starts"))


@query("SELECT user_id, round(list_reduce([0.45::DOUBLE] || list(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY event_id), lambda a, x: CASE WHEN x = 1 THEN greatest(0.2, a - 0.02) ELSE least(0.9, a + 0.03) END), 6) AS threshold FROM events GROUP BY 1")
def answer_threshold(spark, sf):
    """Events as feedback, purchases as praise."""
    return control.threshold_after(table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("positive")), "user_id", "event_id")


@query(
    f"""WITH {ADMITTED}, {PAIRS}, best AS (SELECT seq, text, quality FROM kept ORDER BY quality DESC, seq LIMIT 12000),
used AS (SELECT *, sum(length(text)) OVER (ORDER BY quality DESC, seq) AS used FROM best),
newest AS (SELECT * FROM (SELECT * FROM pairs ORDER BY conv_id DESC, turn DESC LIMIT 1200) WHERE length(bot) <= 200 ORDER BY conv_id DESC, turn DESC LIMIT 400)
SELECT 'doc' AS kind, seq AS at, md5(text) AS digest FROM used WHERE used <= 1500000 UNION ALL SELECT 'dialog', conv_id * 1000 + turn, md5("user" || '|' || bot) FROM newest"""
)
def export_bundle(spark, sf):
    """What goes into an export, by digest."""
    found = dialogs.pairs(table(spark, sf, "conversations"))
    rows = control.exported(kept(spark, sf), found)
    doc, said = F.from_json("value", "text string")["text"], F.from_json("value", "user string, bot string")
    return rows.select("kind", "at", F.md5(F.when(F.col("kind") == "doc", doc).otherwise(F.concat(said["user"], F.lit("|"), said["bot"]))).alias("digest"))


@query("WITH s AS (SELECT 'sentences' AS part, sum(200 + 2 * length(text)) AS bytes FROM documents UNION ALL SELECT 'vectors', sum(8 * len(embedding)) FROM embeddings UNION ALL SELECT 'ngrams', sum(12 * length(text)) FROM conversations) SELECT part, CAST(bytes AS BIGINT) AS bytes, bytes > 0.85 * 4e6 * CASE part WHEN 'ngrams' THEN 0.45 WHEN 'sentences' THEN 0.30 ELSE 0.10 END AS over FROM s")
def memory_budgets(spark, sf):
    """Which parts of a store of four million bytes are over their share."""
    docs = table(spark, sf, "documents").agg(F.lit("sentences").alias("part"), F.sum(200 + 2 * F.length("text")).alias("bytes"))
    vectors = table(spark, sf, "embeddings").agg(F.lit("vectors").alias("part"), F.sum(8 * F.size("embedding")).alias("bytes"))
    grams = table(spark, sf, "conversations").agg(F.lit("ngrams").alias("part"), F.sum(12 * F.length("text")).alias("bytes"))
    return control.budgets(docs.unionByName(vectors).unionByName(grams), 4e6).select("part", "bytes", "over")


@query()
def honest_confidence(spark, sf):
    """The confidence of each golden question's hits after doubts about its subject and attribute."""
    rows = stored(kept(spark, sf), "kept")
    asked = golden.frame(spark, golden.QUESTIONS, "id")
    hits = search.bm25(rows, asked, 5).join(rows.select("seq", "text"), "seq")
    hits = hits.select("id", "seq", search.confidence(F.col("score"), F.col("cover")).alias("confidence"), "rank", "text")
    said = asked.select("id", T.is_question("text").alias("asks"), facts.parse_question(F.col("text")).alias("p"), T.keywords("text", 2).alias("keys"))
    words = F.coalesce(F.col("p.subject"), F.get("keys", F.lit(0)))
    subjects = said.select("id", F.explode(T.terms(words)).alias("term"))
    seen = rows.select(F.explode(T.terms("text")).alias("term")).join(F.broadcast(subjects.select("term").distinct()), "term", "left_semi").select("term").distinct()
    known = subjects.join(seen, "term", "left_semi").select("id").distinct().select("id", F.lit(True).alias("k"))
    questions = said.join(known, "id", "left").select("id", F.coalesce("k", F.lit(False)).alias("known"), "asks", "keys", F.col("p.relation").alias("attribute"), F.array_compact(F.array("p.relation")).alias("synonyms"))
    out = control.doubted(hits, questions)
    return out.select("id", "seq", F.round("confidence", 4).alias("confidence"), "rank")


_PLAN = [("t", "wikipedia", 0.9, 1.0, 2), ("t", "wikidata", 0.8, 1.0, 5), ("t", "wikibooks", 0.7, 0.5, 5), ("t", "wikisource", 0.1, 1.0, 9), ("u", "wikinews", 1.0, 0.6, 1), ("u", "wikidata", 0.5, 1.0, 1)]


@query()
def source_plan(spark, sf):
    """Golden sources; tests hold the rules."""
    return web.source_plan(spark.createDataFrame(_PLAN, "topic string, source string, score double, weight double, found int"))


@query(
    """WITH g AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS v, format('{:.6g}', CAST(o_totalprice AS DOUBLE)) AS t FROM orders)
SELECT o_orderkey, CASE WHEN v = floor(v) THEN format('{:,}', CAST(v AS BIGINT)) ELSE format('{:,}', CAST(split_part(t, '.', 1) AS BIGINT)) || CASE WHEN contains(t, '.') THEN '.' || split_part(t, '.', 2) ELSE '' END END AS text FROM g"""
)
def number_text(spark, sf):
    """Prices of orders as text."""
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", control.number_text(F.col("o_totalprice").cast("double")).alias("text"))
