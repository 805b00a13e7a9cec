"""Queries of what adapts: source health, strategies, intervals, interests, frontier, trends, regressions, training logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import adaptive
from corpusmill.plans import golden
from corpusmill.operators.store import stored
from corpusmill.plans.registry import query, table

LOG = "SELECT event_type AS source, event_id AS seq, value >= 20 AS ok, round(value, 2) AS learned, round(value * 3, 2) AS new_terms, round(value / 10, 4) AS latency, round(value / 20, 4) AS surprise FROM events WHERE value IS NOT NULL"


def log(spark, sf):
    """Events as a log of visits to sources."""
    v = F.col("value")
    return table(spark, sf, "events").where("value is not null").select(
        F.col("event_type").alias("source"), F.col("event_id").alias("seq"), (v >= 20).alias("ok"), F.round(v, 2).alias("learned"), F.round(v * 3, 2).alias("new_terms"), F.round(v / 10, 4).alias("latency"), F.round(v / 20, 4).alias("surprise")
    )


_FOLD = "list_reduce([0.0] || list({c} ORDER BY seq), lambda a, x: CASE WHEN a <> 0 THEN a * 0.8 + x * (1 - 0.8) ELSE x END)"


@query(
    f"""WITH l AS ({LOG}), g AS (SELECT source, count(*) AS tries, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS ok, sum(least(learned, 400) / 100) AS gain, sum(least(new_terms, 2000) / 200) AS novelty, {_FOLD.format(c='latency')} AS latency, {_FOLD.format(c='surprise')} AS s FROM l GROUP BY 1),
v AS (SELECT *, CAST(CASE WHEN s < 1 THEN 0.2 WHEN s > 6 THEN 0.3 WHEN s BETWEEN 2 AND 5 THEN 1.0 ELSE 0.7 END AS DOUBLE) AS value FROM g)
SELECT source, tries, ok, round(latency, 6) AS latency, value, round((ok + 1) / (tries + 2) * (gain / tries + novelty / tries + 0.5) * (0.5 + value), 4) AS score FROM v"""
)
def source_health(spark, sf):
    return adaptive.source_health(log(spark, sf)).withColumn("score", F.round("score", 4))


@query(f"WITH l AS ({LOG}), g AS (SELECT source AS strategy, count(*) AS tries, sum(least(learned, 400.0) / 100) AS gain FROM l GROUP BY 1) SELECT strategy, tries, round(gain, 4) AS gain, round(gain / tries + sqrt(2 * ln(t) / tries), 4) AS ucb FROM g, (SELECT sum(tries) + 1 AS t FROM g)")
def ucb1_strategy(spark, sf):
    return adaptive.strategy_scores(log(spark, sf).withColumnRenamed("source", "strategy")).select("strategy", "tries", F.round("gain", 4).alias("gain"), F.round("ucb", 4).alias("ucb"))


@query(f"WITH l AS ({LOG}), m AS (SELECT source, seq, avg(learned) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM l) SELECT source, seq, CAST(CASE WHEN m >= 100 THEN 15 WHEN m >= 20 THEN 30 WHEN m = 0 THEN 240 ELSE 60 END AS DOUBLE) AS wait FROM m")
def adaptive_interval(spark, sf):
    return log(spark, sf).select("source", "seq", adaptive.adaptive_interval(F.col("learned"), 60.0, ["source"], "seq").cast("double").alias("wait"))


@query("SELECT user_id AS topic, round(list_reduce([0.0::DOUBLE] || list(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END ORDER BY event_id), lambda a, x: least(5.0, a * 0.9 + x)), 6) AS interest FROM events GROUP BY 1")
def interest_fold(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("topic"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.3).alias("weight"))
    return adaptive.interests(rows)


@query("WITH l AS (SELECT page_id AS seq, url AS target, split_part(url, '/', 4) AS anchor, page_id % 5 AS depth, round((page_id * 37 % 100) / 50.0 - 1, 6) AS interest FROM pages) SELECT seq, target, round(interest - 0.3 * depth, 6) AS priority FROM l WHERE depth <= 3 AND interest - 0.3 * depth > -0.9 AND length(anchor) BETWEEN 1 AND 80 AND seq % 10 <> 0 ORDER BY priority DESC, seq LIMIT 100")
def frontier_topk(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("seq"), F.col("url").alias("target"), F.split_part("url", F.lit("/"), F.lit(4)).alias("anchor"), (F.col("page_id") % 5).alias("depth"), F.round((F.col("page_id") * 37 % 100) / 50.0 - 1, 6).alias("interest"))
    return adaptive.frontier(pages, pages.where("seq % 10 = 0"), 100).select("seq", "target", "priority")


@query("WITH d AS (SELECT event_type, CAST(ts AS DATE) AS d, round(avg(value), 6) AS v FROM events GROUP BY 1, 2), t AS (SELECT event_type, d, round(avg(v) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS recent, round(avg(v) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING), 6) AS earlier FROM d) SELECT event_type, strftime(d, '%Y-%m-%d') AS d, recent, earlier, recent >= earlier AS plateau FROM t")
def plateau_test(spark, sf):
    days = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.round(F.avg("value"), 6).alias("v"))
    return days.withColumns(adaptive.trend(F.col("v"), "d", ["event_type"], 5)).select("event_type", F.date_format("d", "yyyy-MM-dd").alias("d"), "recent", "earlier", "plateau")


@query("WITH d AS (SELECT event_type, CAST(ts AS DATE) AS d, round(sum(value), 4) AS v FROM events GROUP BY 1, 2), l AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY d) AS before FROM d) SELECT event_type, strftime(d, '%Y-%m-%d') AS d, v, before, coalesce(v < before * 0.95, FALSE) AS regressed FROM l")
def regression_gate(spark, sf):
    days = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.round(F.sum("value"), 4).alias("v"))
    return adaptive.regressions(days, "v", "d", True, ["event_type"]).withColumn("d", F.date_format("d", "yyyy-MM-dd"))


@query("SELECT CAST(s AS BIGINT) AS step, round(CASE WHEN s < 10 THEN 0.003 * (s + 1) / 10 ELSE 0.003 END, 9) AS constant, round(CASE WHEN s < 10 THEN 0.003 * (s + 1) / 10 ELSE 0.003 * (0.1 + 0.9 * 0.5 * (1 + cos(least(1.0, (s - 10) / 90) * 3.141592653589793))) END, 9) AS cosine FROM range(120) r(s)")
def learning_rate(spark, sf):
    s = F.col("step")
    return spark.range(120).withColumnRenamed("id", "step").select("step", F.round(adaptive.warmup_schedule(s, 10, 0.003, 100, 0.1, False), 9).alias("constant"), F.round(adaptive.warmup_schedule(s, 10, 0.003, 100, 0.1, True), 9).alias("cosine"))


_LINES = [
    "step 100 loss 3.5 6400 tok/s  {'neural_ppl': 30.1} 経過 1.5 分",
    "ニューラル LM: 層を追加 -> 5 層 (3000000 params)",
    "  収集 [topic] 東京 : 12 文, 会話 3 (会話計 40)",
    "step 200 loss 3.1 6300 tok/s  {} 経過 3.0 分",
    "ニューラル LM: 中間次元を拡張 -> ff=512 (4000000 params)",
    "成長が裏目に出たため取り消し (ppl 30.1 -> 35.2、4 層へ戻す)",
    "step 200 loss 3.0 6200 tok/s  {} 経過 3.1 分",
    "noise",
]
_STEP = r"^step ([0-9]+) loss ([0-9.]+) ([0-9]+) tok/s"
_GROWN = r"層を追加 -> ([0-9]+) 層|拡張 -> ff=([0-9]+)|、([0-9]+) 層へ戻す"


@query(
    f"""WITH l AS (SELECT * FROM ({golden.values(_LINES)}) v(i, line)), s AS (SELECT i, line, TRY_CAST(regexp_extract(line, '{_STEP}', 1) AS BIGINT) AS own FROM l),
c AS (SELECT i, line, own, coalesce(last_value(own IGNORE NULLS) OVER (ORDER BY i), 0) AS step FROM s)
SELECT step, CASE WHEN own IS NOT NULL THEN 'step' WHEN line LIKE '%層を追加%' THEN 'layer' WHEN line LIKE '%拡張%' THEN 'width' ELSE 'rollback' END AS kind,
coalesce(TRY_CAST(regexp_extract(line, '{_STEP}', 2) AS DOUBLE), TRY_CAST(regexp_extract(line, '{_GROWN}', 1) AS DOUBLE), TRY_CAST(regexp_extract(line, '{_GROWN}', 2) AS DOUBLE), TRY_CAST(regexp_extract(line, '{_GROWN}', 3) AS DOUBLE)) AS value
FROM c WHERE own IS NOT NULL OR regexp_matches(line, '{_GROWN}') QUALIFY own IS NULL OR row_number() OVER (PARTITION BY own ORDER BY i DESC) = 1"""
)
def training_log(spark, sf):
    """Steps (the last line of each counts) and growth, which carries the last step forward. One log is one ordered file."""
    number = lambda p, g: F.regexp_extract("line", p, g).try_cast("double")
    rows = golden.frame(spark, _LINES, "i").withColumnRenamed("text", "line").withColumn("own", F.regexp_extract("line", _STEP, 1).try_cast("long"))
    rows = rows.withColumn("step", F.coalesce(F.last("own", ignorenulls=True).over(Window.orderBy("i")), F.lit(0)))
    again = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("i")))
    rows = rows.where(F.col("own").isNotNull() | F.col("line").rlike(_GROWN)).withColumn("k", again).where("own is null or k = 1")
    kind = F.when(F.col("own").isNotNull(), "step").when(F.col("line").contains("層を追加"), "layer").when(F.col("line").contains("拡張"), "width").otherwise("rollback")
    return rows.select("step", kind.alias("kind"), F.coalesce(number(_STEP, 2), number(_GROWN, 1), number(_GROWN, 2), number(_GROWN, 3)).alias("value"))


@query(
    """WITH RECURSIVE size AS (SELECT max(page_id) + 1 AS n FROM pages), edges AS (SELECT page_id AS a, unnest([(page_id * 7 + 3) % n, (page_id * 11 + 5) % n, (page_id * 13 + 8) % n]) AS b FROM pages, size),
walk AS (SELECT 0 AS depth, CAST(0 AS BIGINT) AS node UNION SELECT depth + 1, b FROM walk JOIN edges e ON e.a = node WHERE depth < 6) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY 1"""
)
def crawl_frontier(spark, sf):
    """Breadth-first over the links among all pages, six steps: each step's new nodes are those not seen."""
    pages = table(spark, sf, "pages").select("page_id")
    n = F.lit(pages.agg((F.max("page_id") + 1).alias("n")).first().n)
    edges = stored(pages.select(F.col("page_id").alias("a"), F.explode(F.array(*[(F.col("page_id") * x + y) % n for x, y in ((7, 3), (11, 5), (13, 8))])).alias("b")), "links")
    return adaptive.walked(edges, spark.sql("SELECT CAST(0 AS BIGINT) AS node"), 6)


@query("SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, CAST(count(*) AS BIGINT) AS pages, CAST(sum(CASE WHEN regexp_matches(url, '[?#]') THEN 1 ELSE 0 END) AS BIGINT) AS with_query FROM pages GROUP BY 1")
def same_host_links(spark, sf):
    return table(spark, sf, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.col("url").rlike("[?#]").cast("int")).alias("with_query"))
