"""Queries of dialogs, replay, diversity and training arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed as K
from corpusmill.functions import text as T
from corpusmill.operators import adaptive, dialogs
from corpusmill.plans import duck, golden
from corpusmill.plans.registry import query, table
from corpusmill.plans.text_queries import clean_reply  # noqa: F401  the cleaning of replies is a query of its own

_FIELD = duck.strip("replace(coalesce(text, ''), '�', '')")
PAIRS = f"""said AS (SELECT conv_id, turn, lower(role) AS role, CASE WHEN lower({_FIELD}) IN {duck.words(K.MISSING_FIELD)} THEN '' ELSE {_FIELD} END AS text FROM conversations WHERE lower(role) IN ('human', 'user', 'prompter', 'gpt', 'assistant', 'bot')),
lagged AS (SELECT *, lag(text) OVER w AS user, lag(role) OVER w AS asked FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, user, text AS bot FROM lagged WHERE role IN ('gpt', 'assistant', 'bot') AND asked IN ('human', 'user', 'prompter') AND user <> ''),
histories AS (SELECT *, coalesce(array_to_string(list(user || ' / ' || bot) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ' // '), '') AS history FROM pairs)"""


def pairs(spark, sf):
    return dialogs.pairs(table(spark, sf, "conversations"))


@query(f'WITH {PAIRS} SELECT conv_id, turn, "user", bot, history FROM histories')
def dialog_pairs_with_history(spark, sf):
    return pairs(spark, sf)


@query(f'WITH {PAIRS} SELECT conv_id % 5 AS source, count(*) AS n, count(*) FILTER (history <> \'\') AS with_history FROM histories GROUP BY 1')
def dialogs_by_source(spark, sf):
    found = pairs(spark, sf).withColumn("source", F.col("conv_id") % 5)
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("history") != "").alias("with_history"))




@query()
def dialog_store(spark, sf):
    """Pairs as admitted for training; its parts have SQL twins, and tests hold the whole."""
    return dialogs.admitted(pairs(spark, sf).select("conv_id", "turn", "user", "bot"))


@query("SELECT conv_id, turn, lag(text, 1) OVER w AS before_1, lag(text, 2) OVER w AS before_2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def recent_turns(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lag("text", 1).over(w).alias("before_1"), F.lag("text", 2).over(w).alias("before_2"))


_STOPLESS = f"list_filter({duck.terms('x')}, lambda t: {duck.weight('t')} >= 1)"


@query(f"SELECT a.conv_id, a.turn, len(list_intersect({_STOPLESS.replace('(x', '(a.text').replace(' x', ' a.text')}, {_STOPLESS.replace('(x', '(b.text').replace(' x', ' b.text')})) > 0 AS related FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def relevant_history(spark, sf):
    """Whether the turn before shares an informative term."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.filter(T.terms("text"), lambda t: T.term_weight(t) >= 1.0).alias("t"))
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("t").alias("b"))
    return rows.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.arrays_overlap("t", "b").alias("related"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= CASE event_type WHEN 'click' THEN 300 WHEN 'view' THEN 200 ELSE 100 END")
def kind_caps(spark, sf):
    """The newest rows of each kind, up to its cap."""
    return dialogs.capped(table(spark, sf, "events").select("event_id", "event_type"), "event_type", [F.desc("event_id")], {"click": 300, "view": 200}, 100)


@query("WITH r AS (SELECT event_id FROM events ORDER BY md5('r' || CAST(event_id AS VARCHAR)), event_id LIMIT 250), f AS (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 750) SELECT event_id, event_id IN (SELECT event_id FROM r) AS reservoir FROM (SELECT event_id FROM r UNION SELECT event_id FROM f)")
def reservoir_and_newest(spark, sf):
    """A uniform reservoir beside the newest rows."""
    ids = table(spark, sf, "events").select("event_id")
    reservoir = ids.orderBy(F.md5(F.concat(F.lit("r"), F.col("event_id").cast("string"))), "event_id").limit(250).withColumn("reservoir", F.lit(True))
    newest = ids.orderBy(F.desc("event_id")).limit(750).withColumn("reservoir", F.lit(False))
    return reservoir.unionByName(newest).groupBy("event_id").agg(F.max("reservoir").alias("reservoir"))


_UNIFORM = "(CAST('0x' || substr(md5('w' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) + 1) / 4294967297.0"


@query(f"SELECT event_id FROM events ORDER BY round(-ln({_UNIFORM}) / pow(greatest(abs(value), 0.05), 0.6), 9), event_id LIMIT 200")
def prioritized_sample(spark, sf):
    """Rows drawn in proportion to priority to the power 0.6."""
    weight = F.pow(F.greatest(F.abs("value"), F.lit(0.05)), F.lit(0.6))
    return adaptive.weighted_choice(table(spark, sf, "events").select("event_id", "value"), "event_id", weight, 200, "w").select("event_id")


@query("WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM conversations WHERE role = 'assistant'), n AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS characters, round(-sum(n / t * log2(n / t)), 6) AS bits FROM n, (SELECT sum(n) AS t FROM n)")
def unigram_entropy(spark, sf):
    """Bits of each character of the replies."""
    n = table(spark, sf, "conversations").where("role = 'assistant'").select(F.explode(F.split("text", "")).alias("ch")).where("ch != ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.col("t")
    return n.join(F.broadcast(n.agg(F.sum("n").alias("t"))), F.lit(True)).agg(F.sum("n").alias("characters"), F.round(-F.sum(p * F.log2(p)), 6).alias("bits"))


_REPLY_TOKENS = duck.matches("lower(text)", K.WORD)


@query(f"WITH t AS (SELECT {_REPLY_TOKENS} AS t FROM conversations WHERE role = 'assistant'), b AS (SELECT t[i] || ' ' || t[i + 1] AS b FROM (SELECT t, unnest(range(1, len(t))) AS i FROM t)) SELECT count(*) AS pairs, round(count(DISTINCT b) / count(*), 6) AS distinct2 FROM b")
def distinct_pairs(spark, sf):
    """The share of distinct token pairs in the replies."""
    t = table(spark, sf, "conversations").where("role = 'assistant'").select(T.all_matches(F.lower("text"), K.WORD).alias("t")).where(F.size("t") > 1)
    b = t.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1)))).alias("b"))
    n = b.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("pairs"), F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("distinct2"))


@query(f"WITH r AS (SELECT conv_id * 1000 + turn AS id, {_REPLY_TOKENS} AS t FROM conversations WHERE role = 'assistant'), g AS (SELECT id, array_to_string(t[i:i + 3], ' ') AS g FROM (SELECT id, t, unnest(range(1, len(t) - 2)) AS i FROM r)), d AS (SELECT DISTINCT array_to_string(t[i:i + 3], ' ') AS g FROM (SELECT t, unnest(range(1, len(t) - 2)) AS i FROM (SELECT {_REPLY_TOKENS} AS t FROM documents))) SELECT id, count(*) AS grams, count(d.g) AS grounded FROM g LEFT JOIN d ON g.g = d.g GROUP BY 1")
def reply_grounding(spark, sf):
    """How many of each reply's runs of four tokens the documents have."""
    four = lambda df, *keep: df.select(*keep, T.all_matches(F.lower("text"), K.WORD).alias("t")).where(F.size("t") >= 4).select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 3), lambda i: F.array_join(F.slice("t", i, 4), " "))).alias("g"))
    replies = table(spark, sf, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    g = four(replies, "id")
    # only runs that some reply has are looked for
    known = four(table(spark, sf, "documents")).join(g.select("g").distinct(), "g", "left_semi").distinct().withColumn("is_known", F.lit(1))
    return g.join(known, "g", "left").groupBy("id").agg(F.count(F.lit(1)).alias("grams"), F.count("is_known").alias("grounded"))


@query("WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, round(v[CAST(floor(len(v) * 0.5) AS INT) + 1], 6) AS p50, round(v[least(len(v), CAST(floor(len(v) * 0.95) AS INT) + 1)], 6) AS p95, round(v[-1], 6) AS most FROM s")
def latency_percentiles(spark, sf):
    """The value at floor(n p) of the sorted values, by type."""
    rows = table(spark, sf, "events").where("value is not null").select("event_type", "value")
    return dialogs.values_at(rows, "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT conv_id, turn, array_to_string(list_transform(range(0, least(length(text), 12)), lambda i: CASE WHEN i < greatest(turn - 1, 0) THEN 0.2 ELSE 1.0 END), ',') AS weights FROM conversations WHERE length(text) > 0")
def token_weights(spark, sf):
    w = dialogs.token_weights(F.least(F.length("text"), F.lit(12)), F.col("turn"), F.lit(1.0))
    return table(spark, sf, "conversations").where("length(text) > 0").select("conv_id", "turn", F.array_join(w.cast("array<string>"), ",").alias("weights"))


_IDS = f"{_REPLY_TOKENS}"


@query(f"WITH t AS (SELECT conv_id, turn, {_IDS} AS t FROM conversations) SELECT conv_id, turn, CASE WHEN len(t) >= 2 THEN array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(t)), lambda i: t[i] = t[-1]), lambda i: t[i + 1]))), ' ') ELSE '' END AS banned FROM t")
def banned_next_tokens(spark, sf):
    """What followed earlier copies of each turn's last token."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", T.all_matches(F.lower("text"), K.WORD).alias("t"))
    return t.select("conv_id", "turn", F.array_join(dialogs.banned_next(F.col("t"), 2), " ").alias("banned"))


_JSON = [
    ("instruction", '{"instruction": "訳して", "input": "hello", "output": "こんにちは"}'),
    ("qa", '{"title": "Q", "answer": "A."}'),
    ("qa_text", '{"question": "Q", "answer": {"text": "A"}}'),
    ("wikiqa", '{"query": "首都は", "answer": "東京", "text": "日本の首都は東京である。"}'),
    ("squad", '{"question": "Where?", "context": "It is in Paris now.", "answers": {"text": ["Paris"], "answer_start": [9]}}'),
    ("preference", '{"conversations": [{"from": "human", "value": "hi"}], "chosen": "hello", "rejected": "go away"}'),
    ("qa", '{"question": "nan", "answer": "x"}'),
]


@query()
def dialog_formats(spark, sf):
    """Golden rows of six public formats; tests hold the pairs."""
    rows = spark.createDataFrame(_JSON, "kind string, row string")
    out = None
    for kind in sorted({k for k, _ in _JSON}):
        part = dialogs.from_json_rows(rows.where(F.col("kind") == kind), kind).select(F.lit(kind).alias("kind"), "user", "bot", "context", "weight")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.missing'), ''), json_extract_string(props, '$.k')) AS field FROM events")
def json_field(spark, sf):
    """The first of two JSON fields that is neither missing nor empty."""
    return table(spark, sf, "events").select("event_id", F.coalesce(F.nullif(F.get_json_object("props", "$.missing"), F.lit("")), F.get_json_object("props", "$.k")).alias("field"))


_QUOTES = ["「行くのか」と聞いた。「行くよ」と答えた。", "「一つ」「二つ」「三つ」そして「三つ」", "「遠い」" + "間" * 50 + "「離れた」"]


@query()
def quote_pairs(spark, sf):
    """Quotations that answer each other, in golden texts and documents; tests hold them."""
    return dialogs.quote_pairs(golden.frame(spark, _QUOTES).unionByName(table(spark, sf, "documents").select("doc_id", "text")))
