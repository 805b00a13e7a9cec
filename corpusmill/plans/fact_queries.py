"""Queries of facts: extraction, votes, conflicts, chains, questions, agent tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed as K
from corpusmill.functions import text as T
from corpusmill.operators import corpus, facts
from corpusmill.plans import duck, golden
from corpusmill.plans.corpus_queries import SENTENCES, numbered
from corpusmill.plans.registry import query, table


def _sql_candidate(kind: str, pattern: str, subject: int, relation: int, object_: int, japanese: bool) -> str:
    flags = ", 'i'" if pattern.startswith("(?i)") else ""
    quoted = golden.quoted(pattern.removeprefix("(?i)"))
    part = lambda i: f"regexp_replace(regexp_extract(s, {quoted}, {i}{flags}), '^[ 、,。.:：「」『』()（）]+|[ 、,。.:：「」『』()（）]+$', '', 'g')"
    rel = f"lower({part(relation)})" if relation and not japanese else part(relation) if relation else f"'{kind}'"
    obj, found = part(object_), f"regexp_matches(s, {quoted}{flags})"
    if japanese:
        found += f" AND NOT regexp_matches(substr(s, 1, instr(s, regexp_extract(s, {quoted}, {subject})) - 1), '{facts.PARTICLES}$')"
        if kind == "attr":
            rel = f"CASE WHEN regexp_matches({obj}, '{facts.PLACED}') AND {rel} IN ('場所', '所在地', '位置') THEN 'location' ELSE {rel} END"
            obj = f"regexp_replace({obj}, '{facts.PLACED}', '')"
        if kind == "event":
            obj = f"{obj} || 'に' || {part(3)}"
    return f"SELECT seq, source, {'{k}'} AS k, {duck.strip(part(subject))} AS subject, {rel} AS relation, {obj} AS object FROM gated WHERE {'NOT ' if japanese else ''}plain AND {found}"


_ALL = [_sql_candidate(*p, japanese=j).replace("{k}", str(i)) for j, ps in ((False, facts.ENGLISH), (True, facts.JAPANESE)) for i, p in enumerate(ps)]
FACTS = f"""{SENTENCES},
gated AS (SELECT seq, source, text AS s, regexp_matches(text, '^[\\x00-\\x7F]*$') AS plain FROM numbered WHERE length(text) BETWEEN 6 AND 200 AND CASE WHEN regexp_matches(text, '^[\\x00-\\x7F]*$') THEN {duck.test('text', K.EN_VERB)} ELSE {duck.test('right(text, 14)', K.JA_TAIL)} END),
found AS ({' UNION ALL '.join(_ALL)}),
good AS (SELECT * FROM found WHERE subject <> '' AND NOT regexp_matches(subject, {golden.quoted(K.BAD_SUBJECT)}) AND length(object) BETWEEN 2 AND 80
  AND ({duck.is_phrase('lower(subject)')} OR len(list_filter({duck.keywords('subject', 2)}, lambda w: {duck.is_phrase('w')})) > 0)),
facts AS (SELECT seq, source, replace(lower(subject), ' ', '') AS subject_key, subject, relation, object FROM good QUALIFY row_number() OVER (PARTITION BY seq ORDER BY k) = 1)"""


def found(spark: SparkSession, sf: str) -> DataFrame:
    return facts.facts(numbered(spark, sf))


@query(f"WITH {FACTS} SELECT seq, source, subject_key, subject, relation, object FROM facts")
def fact_extract(spark, sf):
    return found(spark, sf)


_CLAIM = r"lower(regexp_replace(object, '[\s、,。.]', '', 'g'))"
SUPPORT = f"""{FACTS}, groups AS (SELECT subject_key, relation, {_CLAIM} AS claim, count(DISTINCT source) AS sources, count(*) AS sentences, min(seq) AS first_seq FROM facts GROUP BY 1, 2, 3),
support AS (SELECT *, row_number() OVER (PARTITION BY subject_key, relation ORDER BY sources DESC, sentences DESC, first_seq) AS rank FROM groups)"""


@query(f"WITH {SUPPORT} SELECT subject_key, relation, claim, sources, sentences, first_seq, rank FROM support")
def fact_support_vote(spark, sf):
    return facts.support(found(spark, sf))


@query(f"WITH {SUPPORT} SELECT subject_key, relation, claim, sources, sentences, first_seq, rank FROM support WHERE (subject_key, relation) IN (SELECT (subject_key, relation) FROM support WHERE rank = 2)")
def fact_conflicts(spark, sf):
    return facts.conflicts(found(spark, sf))


_CHAINS = [(1, "アルファ社", ["本社", "人口"]), (2, "日本", ["首都", "人口"]), (3, "東京", ["人口", "面積"])]


@query(
    f"""WITH {FACTS}, one AS (SELECT replace(lower(subject), ' ', '') AS k, relation, arg_min(object, seq) AS object, min(seq) AS seq FROM facts GROUP BY 1, 2),
asked(id, k, r1, r2) AS (VALUES (1, 'アルファ社', '本社', '人口'), (2, '日本', '首都', '人口'), (3, '東京', '人口', '面積'))
SELECT CAST(id AS BIGINT) AS id, b.object AS answer, b.seq FROM asked JOIN one a ON a.k = asked.k AND a.relation = r1 JOIN one b ON b.k = replace(lower(a.object), ' ', '') AND b.relation = r2"""
)
def fact_multihop(spark, sf):
    asked = spark.createDataFrame(_CHAINS, "id long, subject string, relations array<string>")
    return facts.chain(asked, found(spark, sf), 2)


@query()
def parse_questions(spark, sf):
    """Subject and relation of golden questions and benchmark items; nested alternatives of the patterns differ in RE2, so tests hold it."""
    from corpusmill.plans.text_queries import questions

    return questions(spark, sf).select("id", "text", facts.parse_question(F.col("text")).alias("q")).select("id", "text", "q.subject", "q.relation")


@query()
def fact_answers(spark, sf):
    """Answers to the golden questions; tests hold them."""
    return facts.answers(golden.frame(spark, golden.QUESTIONS, "id"), found(spark, sf))


_LOOKUPS = [(1, "東京タワー", "高さ"), (2, "東京タワー", "標高"), (3, "富士山", "height"), (4, "Paris", "what"), (5, "日本", "首"), (6, "東京タワー", "色")]


@query(
    f"""WITH {FACTS}, asked(id, subject, asked) AS (VALUES {', '.join(f"({i}, '{s}', '{r}')" for i, s, r in _LOOKUPS)}),
alias(a, s) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in facts.aliases())}),
t AS (SELECT id, f.*, CASE WHEN relation = lower(asked) THEN 1 WHEN EXISTS (SELECT 1 FROM alias WHERE a = lower(asked) AND s = relation) THEN 2 WHEN length(asked) >= 2 AND (instr(relation, lower(asked)) > 0 OR instr(lower(asked), relation) > 0) THEN 3 END AS tier
  FROM asked JOIN facts f ON f.subject_key = replace(lower(asked.subject), ' ', ''))
SELECT CAST(id AS BIGINT) AS id, CAST(tier AS BIGINT) AS tier, relation, object, seq FROM t WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY id)"""
)
def fact_lookup(spark, sf):
    return facts.lookup(spark.createDataFrame(_LOOKUPS, "id long, subject string, relation string"), found(spark, sf))


_SECOND = r"regexp_extract(p, '([0-9][0-9,]*(?:\.[0-9]+)?)(億|万|千)?(?:([0-9][0-9,]*(?:\.[0-9]+)?)(億|万|千))?', {})"
_VALUE = lambda i: f"coalesce(TRY_CAST(replace({_SECOND.format(i)}, ',', '') AS DOUBLE), 0)"
_TIMES = lambda i: f"CASE {_SECOND.format(i)} WHEN '億' THEN 1e8 WHEN '万' THEN 1e4 WHEN '千' THEN 1e3 ELSE 1 END"


@query(f"WITH {SENTENCES}, n AS (SELECT seq, replace(text, ' ', '') AS p FROM numbered WHERE regexp_matches(text, '[0-9]')) SELECT seq, round({_VALUE(1)} * {_TIMES(2)} + CASE WHEN {_SECOND.format(2)} <> '' AND {_SECOND.format(4)} <> '' THEN {_VALUE(3)} * {_TIMES(4)} ELSE 0 END, 6) AS number FROM n")
def number_parse(spark, sf):
    return numbered(spark, sf).where("text rlike '[0-9]'").select("seq", F.round(facts.number_of(F.col("text")), 6).alias("number"))


_CONVERSIONS = [(1, 5.0, "km", "mile"), (2, 100.0, "℃", "°f"), (3, 10.0, "kg", "ポンド"), (4, 3.0, "km", "kg"), (5, 90.0, "分", "時間"), (6, 68.0, "°f", "℃"), (7, 2.0, "l", "ml")]


@query(
    f"""WITH unit(name, dim, factor) AS (VALUES {', '.join(f"('{n}', '{d}', {f}::DOUBLE)" for n, (d, f) in K.UNITS.items())}), asked(id, x, a, b) AS (VALUES {', '.join(f"({i}, {x}::DOUBLE, '{a}', '{b}')" for i, x, a, b in _CONVERSIONS)})
SELECT CAST(id AS BIGINT) AS id, round(CASE WHEN u.dim = 'temp' THEN CASE WHEN u.factor = 0 THEN x * 9 / 5 + 32 ELSE (x - 32) * 5 / 9 END ELSE x * u.factor / v.factor END, 4) AS value FROM asked JOIN unit u ON u.name = a JOIN unit v ON v.name = b AND v.dim = u.dim WHERE u.dim <> 'temp' OR u.factor <> v.factor"""
)
def unit_convert(spark, sf):
    """Conversions by a fixed table of units."""
    unit = F.broadcast(spark.createDataFrame([(n, d, f) for n, (d, f) in K.UNITS.items()], "name string, dim string, factor double"))
    asked = spark.createDataFrame(_CONVERSIONS, "id long, x double, a string, b string")
    u, v = unit.select(F.col("name").alias("a"), "dim", F.col("factor").alias("fa")), unit.select(F.col("name").alias("b"), "dim", F.col("factor").alias("fb"))
    rows = asked.join(u, "a").join(v, ["b", "dim"]).where("dim != 'temp' or fa != fb")
    degrees = F.when(F.col("fa") == 0, F.col("x") * 9 / 5 + 32).otherwise((F.col("x") - 32) * 5 / 9)
    return rows.select("id", F.round(F.when(F.col("dim") == "temp", degrees).otherwise(F.col("x") * F.col("fa") / F.col("fb")), 4).alias("value"))


@query(
    """SELECT o_orderkey, CAST(strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS VARCHAR) AS after_days, CAST(strftime(o_orderdate - INTERVAL 3 DAY, '%Y-%m-%d') AS VARCHAR) AS before_days,
strftime(make_date(CAST(year(o_orderdate) + (month(o_orderdate) + 4) // 12 AS INT), CAST((month(o_orderdate) + 4) % 12 + 1 AS INT), CAST(least(day(o_orderdate), 28) AS INT)), '%Y-%m-%d') AS after_months, dayname(o_orderdate)[1:3] AS weekday FROM orders"""
)
def date_shift(spark, sf):
    """Days and months before and after; a month later keeps the day, the 28th at most."""
    d = F.col("o_orderdate").cast("date")
    months = F.make_date(F.year(d) + F.floor((F.month(d) + 4) / 12).cast("int"), (F.month(d) + 4) % 12 + 1, F.least(F.dayofmonth(d), F.lit(28)))
    iso = lambda x: F.date_format(x, "yyyy-MM-dd")
    return table(spark, sf, "orders").select("o_orderkey", iso(F.date_add(d, 10)).alias("after_days"), iso(F.date_sub(d, 3)).alias("before_days"), iso(months).alias("after_months"), F.date_format(d, "EEE").alias("weekday"))


_BAG = f"list_distinct(list_filter({duck.terms('text')}, lambda t: {duck.is_phrase('t')}))"


@query(
    f"""WITH {duck.sentences(also=None)}, b AS (SELECT doc_id, pos, text, {_BAG} AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM sentences), f AS (SELECT doc_id, t, count(*) AS f FROM (SELECT doc_id, unnest(p) AS t FROM b) GROUP BY 1, 2),
s AS (SELECT b.doc_id, b.pos, any_value(text) AS text, round(coalesce(sum(f), 0) / (any_value(len(p)) + 2) * (1 + 0.5 * (1 - b.pos / any_value(n))) * CASE WHEN length(any_value(text)) BETWEEN 20 AND 200 THEN 1.2 ELSE 1 END, 6) AS score
  FROM (SELECT doc_id, pos, text, p, n, unnest(CASE WHEN len(p) > 0 THEN p ELSE [''] END) AS t FROM b) b LEFT JOIN f ON f.doc_id = b.doc_id AND f.t = b.t GROUP BY 1, 2),
top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos DESC) <= 3)
SELECT doc_id, string_agg(text, ' ' ORDER BY pos) AS summary FROM top GROUP BY 1"""
)
def extractive_summary(spark, sf):
    """The three sentences of each document whose phrases recur most, in their order.

    Documents are dealt out by their id once, so that all that follows counts within a partition.
    """
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    rows = corpus.sentences(docs.repartition("doc_id"))
    rows = rows.select("doc_id", "pos", "text", F.array_distinct(F.filter(T.terms("text"), T.is_phrase)).alias("p"))
    # a sentence without phrases stays, with a term that counts nothing
    each = rows.select("doc_id", "pos", F.explode_outer("p").alias("t"), F.length("text").alias("length"), F.size("p").alias("size"))
    often = F.count("t").over(Window.partitionBy("doc_id", "t"))
    said = each.withColumn("f", F.when(F.col("t").isNotNull(), often).otherwise(0)).groupBy("doc_id", "pos", "length", "size").agg(F.sum("f").alias("f"))
    said = said.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    score = F.col("f") / (F.col("size") + 2) * (1 + 0.5 * (1 - F.col("pos") / F.col("n"))) * F.when(F.col("length").between(20, 200), 1.2).otherwise(1.0)
    best = said.withColumn("score", F.round(score, 6)).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("pos")))).where("k <= 3")
    chosen = best.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    whole = docs.select("doc_id", T.split_sentences("text").alias("s")).join(chosen, "doc_id")
    return whole.select("doc_id", F.array_join(F.transform("at", lambda i: F.element_at("s", i.cast("int") + 1)), " ").alias("summary"))


_MERGE = f"""{FACTS}, judged AS (SELECT seq, text, round({duck.quality('text')}, 9) AS quality, list_distinct({duck.terms('text')}) AS t FROM numbered),
firsts AS (SELECT subject_key, relation, min(seq) AS first FROM facts GROUP BY 1, 2),
pairs AS (SELECT DISTINCT f.seq, g.first FROM facts f JOIN firsts g USING (subject_key, relation) WHERE f.seq > g.first)
SELECT DISTINCT CASE WHEN b.quality < a.quality THEN b.seq ELSE a.seq END AS seq FROM pairs p JOIN judged a ON a.seq = p.seq JOIN judged b ON b.seq = p.first WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) >= 0.7"""


@query(f"WITH {_MERGE}")
def consolidate_merge(spark, sf):
    """The worse of two sentences that state the same in nearly the same words."""
    rows = numbered(spark, sf).withColumn("quality", T.sentence_quality("text"))
    return facts.consolidated(rows, facts.facts(rows))


@query(f"WITH {FACTS}, t(q) AS (VALUES ('{{s}}の{{r}}は?'), ('{{s}} {{r}}?')), c(with_context) AS (VALUES (TRUE), (FALSE)) SELECT seq, replace(replace(q, '{{s}}', subject), '{{r}}', relation) AS question, object AS answer, with_context FROM facts, t, c")
def synthetic_questions(spark, sf):
    """Four training rows for each fact: two templates, with and without its sentence as context."""
    q = F.array(F.concat("subject", F.lit("の"), "relation", F.lit("は?")), F.concat("subject", F.lit(" "), "relation", F.lit("?")))
    rows = found(spark, sf).select("seq", F.explode(q).alias("question"), F.col("object").alias("answer"))
    return rows.select("seq", "question", "answer", F.explode(F.array(F.lit(True), F.lit(False))).alias("with_context"))


_CLOSING = ("など", "等", "といった", "が挙げられる", "がある")
_ENUM = f"([^。、,]{{1,40}}(?:[、,][^。、,]{{1,40}}){{1,8}})(?:{'|'.join(_CLOSING)})"


@query(
    f"""WITH {duck.sentences()}, m AS (SELECT doc_id, pos, unnest(regexp_extract_all(text, '{_ENUM}', 1)) AS m FROM sentences), p AS (SELECT doc_id, pos, unnest(regexp_split_to_array(m, '[、,]')) AS part, generate_subscripts(regexp_split_to_array(m, '[、,]'), 1) AS j FROM m),
c AS (SELECT doc_id, pos, j, regexp_replace(regexp_replace(part, '^[「」 ]+|[「」 ]+$', '', 'g'), '(など|等|といった|が挙げられる|がある)$', '') AS part FROM p)
SELECT DISTINCT doc_id, CASE WHEN j = 1 THEN regexp_replace(part, '^.*?(?:には|としては|として|例えば|たとえば|は|が)', '') ELSE part END AS item FROM c WHERE length(CASE WHEN j = 1 THEN regexp_replace(part, '^.*?(?:には|としては|として|例えば|たとえば|は|が)', '') ELSE part END) BETWEEN 2 AND 30"""
)
def listed_items(spark, sf):
    """What sentences list before a closing word; texts and sentences that have none, or no comma, are neither cut nor matched."""
    from corpusmill.plans.text_queries import sentences

    said = lambda t: F.greatest(*[t.contains(w) for w in _CLOSING]) & (t.contains("、") | t.contains(","))
    matched = F.when(said(F.col("text")), T.all_matches("text", _ENUM, 1)).otherwise(T.strings())
    rows = sentences(spark, sf, said(F.col("text"))).select("doc_id", F.explode_outer(matched).alias("m")).where("m is not null")
    rows = rows.select("doc_id", F.posexplode(F.split("m", "[、,]")).alias("j", "part"))
    part = F.regexp_replace(F.regexp_replace("part", "^[「」 ]+|[「」 ]+$", ""), "(など|等|といった|が挙げられる|がある)$", "")
    lead = F.regexp_replace(part, "^.*?(?:には|としては|として|例えば|たとえば|は|が)", "")
    return rows.select("doc_id", F.when(F.col("j") == 0, lead).otherwise(part).alias("item")).where(F.length("item").between(2, 30)).distinct()
