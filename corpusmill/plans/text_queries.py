"""Queries of the text functions and predicates over sentences (of documents and a few golden texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import fixed as K
from corpusmill.functions import text as T
from corpusmill.operators import corpus
from corpusmill.plans import duck, golden
from corpusmill.plans.registry import query, table


def sentences(spark: SparkSession, sf: str, only: F.Column | None = None) -> DataFrame:
    """doc_id, pos, source, text of all documents and golden texts, or of those of which ``only`` holds."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    docs = docs.unionByName(golden.frame(spark, golden.TEXTS).withColumn("source", F.lit("golden")))
    return corpus.sentences(docs if only is None else docs.where(only))


def over_sentences(*columns: str) -> str:
    return f"WITH {duck.sentences()} SELECT doc_id, pos, {', '.join(columns)} FROM sentences"


def joined(a) -> F.Column:
    return F.array_join(a, "|")


@query(f"WITH {duck.sentences()} SELECT doc_id, pos, text FROM sentences")
def split_sentences(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", "text")


@query(over_sentences(f"array_to_string({duck.matches('lower(' + duck.normalize('text') + ')', K.WORD)}, '|') AS tokens"))
def tokenize(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", joined(T.tokenize("text")).alias("tokens"))


@query(
    f"""WITH {duck.sentences()}, toks AS (SELECT doc_id, pos, {duck.matches('lower(' + duck.normalize('text') + ')', K.WORD)} AS t FROM sentences),
parts AS (SELECT doc_id, pos, i, x, coalesce(lag(x) OVER (PARTITION BY doc_id, pos ORDER BY i), '') AS b FROM (SELECT doc_id, pos, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM toks))
SELECT doc_id, pos, string_agg(CASE WHEN i > 1 AND regexp_full_match(x, {duck.quoted(K.LATIN)}) AND (regexp_full_match(b, {duck.quoted(K.LATIN)}) OR b IN (',', '.', ';', ':', '!', '?')) THEN ' ' ELSE '' END || x, '' ORDER BY i) AS text
FROM parts GROUP BY doc_id, pos"""
)
def detokenize(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", T.detokenize(T.tokenize("text")).alias("text"))


@query(over_sentences(f"array_to_string({duck.terms('text')}, '|') AS terms"))
def search_terms(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", joined(T.terms("text")).alias("terms"))


@query(f"WITH {duck.sentences()}, t AS (SELECT DISTINCT unnest({duck.terms('text')}) AS term FROM sentences) SELECT term, CAST({duck.weight('term')} AS DOUBLE) AS weight, {duck.is_phrase('term')} AS is_phrase FROM t")
def term_weight(spark, sf):
    terms = sentences(spark, sf).select(F.explode(T.terms("text")).alias("term")).distinct()
    return terms.select("term", T.term_weight(F.col("term")).alias("weight"), T.is_phrase(F.col("term")).alias("is_phrase"))


@query(over_sentences(f"array_to_string({duck.phrases('text')}, '|') AS phrases"))
def phrases(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", joined(T.phrases("text")).alias("phrases"))


@query(over_sentences(f"array_to_string({duck.keywords('text')}, '|') AS keywords"))
def keywords(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", joined(T.keywords("text")).alias("keywords"))


@query(over_sentences(f"md5({duck.content_key('text')}) AS content_key", f"CAST(len({duck.matches('lower(text)', K.WORD)}) AS BIGINT) AS n_tokens", f"CAST(len({duck.terms('text')}) AS BIGINT) AS n_terms"))
def analyze(spark, sf):
    return sentences(spark, sf).select(
        "doc_id", "pos", F.md5(T.content_key("text")).alias("content_key"), F.size(T.all_matches(F.lower("text"), K.WORD)).cast("long").alias("n_tokens"), F.size(T.terms("text")).cast("long").alias("n_terms")
    )


@query(f"WITH {duck.sentences()}, t AS (SELECT doc_id, pos, list_sort(list_distinct(list_filter({duck.terms('text')}, lambda t: {duck.weight('t')} >= 1))) AS s FROM sentences) SELECT doc_id, pos, CASE WHEN len(s) >= 4 THEN md5(array_to_string(s, chr(1))) END AS key FROM t")
def content_key_of_terms(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", F.md5(T.content_key_of_terms(T.terms("text"))).alias("key"))


@query(over_sentences(f"{duck.junk('text')} AS is_junk"))
def junk_filter(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", T.is_junk("text").alias("is_junk"))


@query(over_sentences(f"round({duck.quality('text')}, 6) AS quality"))
def sentence_quality(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", F.round(T.sentence_quality("text"), 6).alias("quality"))


_T = duck.strip("text")
_MARKS = f"len(regexp_extract_all({_T}, '[。！？.!?]'))"


@query(
    rf"""SELECT doc_id, NOT (length({_T}) < 40 OR len(regexp_extract_all({_T}, '\x{{FFFD}}')) > length({_T}) * 0.002 OR {_MARKS} < greatest(1, length({_T}) // 200)
  OR {duck.count(_T, r'\p{Nd}')} / greatest(length({_T}), 1) > 0.25
  OR ({duck.count(_T, r'[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]')} / greatest(length({_T}), 1) < 0.15 AND {duck.count(_T, '[A-Za-z]')} / greatest(length({_T}), 1) < 0.40)
  OR ({duck.count(_T, r'[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]')} / greatest(length({_T}), 1) >= 0.15 AND length({_T}) > 120 AND instr({_T}, '、') = 0 AND {_MARKS} < 2)) AS good
FROM documents"""
)
def good_prose(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.good_prose("text").alias("good"))


_FIELDS = ["NaN", " none ", "NULL", "undefined", "ok", "", "�x�", "None of these"]


@query(
    f"""WITH f AS (SELECT * FROM ({golden.values(_FIELDS)}) v(id, x) UNION ALL SELECT doc_id, source FROM documents UNION ALL SELECT CAST(-1 AS BIGINT), NULL),
c AS (SELECT id, {duck.strip("replace(coalesce(x, ''), '�', '')")} AS t FROM f) SELECT id, CASE WHEN lower(t) IN {duck.words(K.MISSING_FIELD)} THEN '' ELSE t END AS field FROM c"""
)
def clean_field(spark, sf):
    some = golden.frame(spark, _FIELDS, "id").withColumnRenamed("text", "x").unionByName(table(spark, sf, "documents").selectExpr("doc_id AS id", "source AS x")).unionByName(spark.sql("SELECT CAST(-1 AS BIGINT) AS id, CAST(NULL AS STRING) AS x"))
    return some.select("id", T.clean_field("x").alias("field"))


@query(f"SELECT doc_id, {duck.test('text', K.PERSONAL)} AS personal FROM documents")
def personal_data_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").rlike(K.PERSONAL).alias("personal"))


_REPLIES = ["以下のような質問があります。", "次のとおりです。例を見てください。とても長い説明がここに続きますので、これは六十文字を超えることになります。本当に長い文です。", "ご紹介します。", "普通の返事です。", "手順を説明します", "例を挙げます。"]


@query(f"WITH r AS (SELECT * FROM ({golden.values(_REPLIES)}) v(id, t) UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations) SELECT id, length(t) < 60 AND {duck.test('t', K.HOLLOW_TAIL)} AS hollow FROM r")
def hollow_reply_filter(spark, sf):
    said = golden.frame(spark, _REPLIES, "id").unionByName(table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS id", "text"))
    return said.select("id", ((F.length("text") < 60) & F.col("text").rlike(K.HOLLOW_TAIL)).alias("hollow"))


_PASSAGE = r"(?i)(この|上記の|次の)(文章|本文|パッセージ)|passage|the text above"


@query(f"SELECT conv_id, turn, NOT {duck.test('text', _PASSAGE)} AS trainable FROM conversations WHERE role = 'assistant'")
def passage_reference_filter(spark, sf):
    said = table(spark, sf, "conversations").where("role = 'assistant'")
    return said.select("conv_id", "turn", (~F.col("text").rlike(_PASSAGE)).alias("trainable"))


_Q = " UNION ALL ".join(["SELECT i AS id, t FROM (" + golden.values(golden.QUESTIONS) + ") v(i, t)", "SELECT item_id, text FROM benchmark", "SELECT conv_id * 1000 + turn, text FROM conversations"])


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """id and text of golden questions, benchmark items and turns."""
    out = golden.frame(spark, golden.QUESTIONS, "id")
    out = out.unionByName(table(spark, sf, "benchmark").selectExpr("item_id AS id", "text"))
    return out.unionByName(table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS id", "text"))


@query(f"WITH q AS ({_Q}) SELECT id, t AS text, {duck.question('t')} AS is_question FROM q")
def is_question(spark, sf):
    return questions(spark, sf).select("id", "text", T.is_question("text").alias("is_question"))


@query(f"WITH q AS ({_Q}) SELECT id, t AS text, {duck.question_type('t')} AS kind FROM q")
def question_type(spark, sf):
    return questions(spark, sf).select("id", "text", T.question_type("text").alias("kind"))


@query(f"WITH q AS ({_Q}) SELECT id, t AS text, {duck.test('lower(' + duck.strip('t') + ')', K.CHAT)} OR len(list_filter({duck.keywords('t', 3)}, lambda k: {duck.is_phrase('k')})) = 0 AS chatty FROM q")
def small_talk(spark, sf):
    return questions(spark, sf).select("id", "text", T.is_chatty("text").alias("chatty"))


@query(f"WITH q AS ({_Q}) SELECT id, {duck.test('lower(t)', K.MORE)} AS more, {duck.test('lower(t)', K.FOLLOW_UP)} AS follow_up, {duck.test('t', K.GARBLED)} AS garbled FROM q")
def utterance_predicates(spark, sf):
    low = F.lower("text")
    return questions(spark, sf).select("id", low.rlike(K.MORE).alias("more"), low.rlike(K.FOLLOW_UP).alias("follow_up"), F.col("text").rlike(K.GARBLED).alias("garbled"))


@query(
    r"""SELECT a.conv_id, a.turn, regexp_replace(lower(a.text), '[^\p{L}\p{N}]', '', 'g') = regexp_replace(lower(b.text), '[^\p{L}\p{N}]', '', 'g') AS same,
round(len(regexp_extract_all(a.text, '[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]')) / greatest(length(a.text), 1), 6) AS cjk_share
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
)
def same_utterance(spark, sf):
    a = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", T.same_utterance("text", "reply").alias("same"), F.round(T.cjk_share("text"), 6).alias("cjk_share"))


_WIKI = ["#REDIRECT [[x]]", "  #redirect y", "#転送 [[東京]]", "普通の本文 #redirect", "x"]


@query(f"WITH w AS (SELECT * FROM ({golden.values(_WIKI)}) v(id, t) UNION ALL SELECT doc_id, text FROM documents), h AS (SELECT id, lower(ltrim(substr(t, 1, 40))) AS s FROM w) SELECT id, starts_with(s, '#redirect') OR starts_with(s, '#転送') AS redirect FROM h")
def redirect_filter(spark, sf):
    pages = golden.frame(spark, _WIKI, "id").unionByName(table(spark, sf, "documents").selectExpr("doc_id AS id", "text"))
    return pages.select("id", T.is_redirect("text").alias("redirect"))


@query(over_sentences(rf"CASE WHEN length(text) NOT BETWEEN 6 AND 200 THEN FALSE WHEN regexp_matches(text, '^[\x00-\x7F]*$') THEN {duck.test('text', K.EN_VERB)} ELSE {duck.test('right(text, 14)', K.JA_TAIL)} END AS may_state"))
def fact_gate(spark, sf):
    from corpusmill.operators.facts import may_state_fact

    return sentences(spark, sf).select("doc_id", "pos", may_state_fact(F.col("text")).alias("may_state"))


_PACKED = r"regexp_replace(text, '\s+', '', 'g')"


@query(
    f"""WITH {duck.sentences()}, k AS (SELECT doc_id, pos, text, {_PACKED} AS k FROM sentences),
g AS (SELECT doc_id, pos, {duck.phrases('text')} AS p, list_transform(range(1, greatest(length(k) - 1, 1)), lambda i: substr(k, i, 3)) AS c FROM k)
SELECT doc_id, pos, round(greatest(CASE WHEN len(p) >= 3 THEN 1 - len(list_distinct(p)) / len(p) ELSE 0 END, CASE WHEN len(c) >= 6 THEN 1 - len(list_distinct(c)) / len(c) ELSE 0 END), 6) AS ratio FROM g"""
)
def repeat_ratio(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", F.round(T.repeat_ratio("text"), 6).alias("ratio"))


@query(
    rf"""WITH {duck.sentences()}, w AS (SELECT doc_id, pos, regexp_extract_all(text, '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}]+|[\x{{30A0}}-\x{{30FF}}]{{2,}}') AS w FROM sentences),
m AS (SELECT doc_id, pos, w, list_max(list_transform(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x)))) AS top FROM w)
SELECT doc_id, pos, round(CASE WHEN len(w) < 5 OR top < 4 OR top / len(w) < 0.25 THEN 0 ELSE least(1.0, (top - 3) / 3) END, 6) AS overuse FROM m"""
)
def term_overuse(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", F.round(T.term_overuse("text"), 6).alias("overuse"))


_ENDED = r"regexp_extract(substr(text, 1, 260), '(?s)^.*[。！？.!?\n]')"


@query(rf"SELECT conv_id, turn, CASE WHEN length(text) <= 220 THEN text WHEN length({_ENDED}) > 20 THEN {duck.strip(_ENDED)} ELSE regexp_replace(substr(text, 1, 220), '\s+$', '') END AS short FROM conversations")
def shorten_reply(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.shorten("text", 220).alias("short"))


_LISTS = ["手順です。\n1. **まず**材料を切ります\n2. 次に鍋で煮ます\n3. 終わり", "## 見出し\nこれは十分に長い説明文なので、箇条書きの前で切ってもよいはずです。\n- 一つ目\n- 二つ目", "以下のような点に注意してください。\n- 温度の管理をする\n- 湿度の管理をする\n- x", "`code` and __bold__  text", "***"]


@query(
    r"""WITH r AS (SELECT * FROM (""" + golden.values(_LISTS) + r""") v(id, t) UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations),
a AS (SELECT id, t AS raw, regexp_replace(regexp_replace(t, '\*+|__+|`+', '', 'g'), '(?m)^\s*#{1,6}\s*', '', 'g') AS t FROM r),
b AS (SELECT id, raw, t, regexp_extract(t, '(?s)^(.*?)\n\s*(?:[0-9]+[.)]|[-*・])', 1) AS head, regexp_matches(t, '\n\s*(?:[0-9]+[.)]|[-*・])') AS cut FROM a),
c AS (SELECT id, raw, t, cut, regexp_replace(head, '^\s+|\s+$', '', 'g') AS lead, list_filter(list_transform(list_filter(string_split(substr(t, length(head) + 1), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''),
  lambda x: regexp_replace(regexp_replace(x, '^\s*(?:[0-9]+[.)]|[-*・])\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 6)[1:2] AS items FROM b),
d AS (SELECT id, raw, CASE WHEN NOT cut THEN t WHEN regexp_matches(lead, '""" + K.HOLLOW + r"""') OR length(lead) < 25 THEN CASE WHEN len(items) > 0 THEN regexp_replace(lead || ' ' || array_to_string(items, ' '), '^\s+|\s+$', '', 'g') ELSE lead END ELSE lead END AS t FROM c),
e AS (SELECT id, raw, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM d)
SELECT id, CASE WHEN t <> '' THEN t ELSE regexp_replace(raw, '^\s+|\s+$', '', 'g') END AS reply FROM e"""
)
def clean_reply(spark, sf):
    said = golden.frame(spark, _LISTS, "id").unionByName(table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS id", "text"))
    return said.select("id", T.clean_reply("text").alias("reply"))


_EDGE = "[ 、,。.:：「」『』()（）]+"


@query(over_sentences(f"regexp_replace(text, '^{_EDGE}|{_EDGE}$', '', 'g') AS operand", "replace(lower(text), ' ', '') AS subject_key"))
def clean_operand(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", T.clean_operand("text").alias("operand"), T.subject_key("text").alias("subject_key"))


_LINE = duck.strip("x")


@query(rf"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \t\x{{3000}}]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), chr(10)), lambda x: {_LINE}), lambda x: length(x) >= 20 OR regexp_matches(x, '[。.!?！？]$')), chr(10))) AS body FROM documents")
def clean_page_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean_page_text("text")).alias("body"))


_GP = r"regexp_replace(lower(text), '\s+', '', 'g')"


@query(f"WITH g AS (SELECT item_id, {_GP} AS p, list_filter(list_transform(range(1, greatest(length({_GP}), 1)), lambda i: substr({_GP}, i, 2)), lambda x: NOT regexp_matches(x, '[、。，．,.!?！？「」『』()（）・]')) AS g FROM benchmark) SELECT item_id, array_to_string(CASE WHEN len(g) = 0 AND p <> '' THEN [p] ELSE g END, '|') AS grams FROM g")
def character_grams(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", joined(T.character_grams("text")).alias("grams"))


@query(
    f"""WITH {duck.sentences()}, k AS (SELECT i AS id, unnest({duck.keywords('t', 2)}) AS key FROM ({golden.values(golden.QUESTIONS)}) v(i, t)),
b AS (SELECT doc_id, pos, text FROM sentences WHERE doc_id >= {golden.FIRST_ID})
SELECT id, key, doc_id, pos, len(list_filter(list_transform(range(1, greatest(length(key) - 1, 2)), lambda i: substr(key, i, 3)), lambda g: instr(text, g) > 0)) > 0 AS fits FROM k, b"""
)
def key_match(spark, sf):
    """Whether the keys of each golden question occur in the golden sentences (both few and fixed)."""
    keys = golden.frame(spark, golden.QUESTIONS, "id").select("id", F.explode(T.keywords("text", 2)).alias("key"))
    bodies = corpus.sentences(golden.frame(spark, golden.TEXTS).withColumn("source", F.lit("golden")))
    pairs = keys.join(F.broadcast(bodies.select("doc_id", "pos", "text")), F.lit(True))
    return pairs.select("id", "key", "doc_id", "pos", T.key_match(F.col("key"), F.col("text")).alias("fits"))


_NFC = [(1, "ＡＢＣ　１２３"), (2, "ﾃｽﾄ"), (3, "plain"), (4, "①é")]


@query()
def nfkc_normalize(spark, sf):
    """Unicode's compatibility form; SQL has none, so tests hold it against the standard library."""
    texts = spark.createDataFrame(_NFC, "doc_id long, text string").unionByName(table(spark, sf, "documents").select("doc_id", "text"))
    return texts.select("doc_id", F.md5(T.normalize(T.nfkc("text"))).alias("text"))


@query(r"SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 3) || '/' || substr(string_split(rtrim(url, '/'), '/')[-1], 1, 40) AS name FROM pages")
def source_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.host_of("url").alias("host"), T.source_name("url").alias("name"))


@query(r"SELECT split_part(url, '/', 3) AS source, count(*) AS n FROM pages GROUP BY 1")
def documents_by_host(spark, sf):
    return table(spark, sf, "pages").groupBy(T.host_of("url").alias("source")).agg(F.count(F.lit(1)).alias("n"))
