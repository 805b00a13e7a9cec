"""Queries of corpus building: de-duplication, admission, retention, postings, n-gram counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed as K
from corpusmill.functions import text as T
from corpusmill.operators import corpus, index, ngram_model, ngrams
from corpusmill.operators.store import stored
from corpusmill.plans import duck, golden
from corpusmill.plans.registry import query, table
from corpusmill.plans.text_queries import sentences

SEQ = "doc_id * 1000000 + pos AS seq"
SENTENCES = duck.sentences() + f", numbered AS (SELECT *, {SEQ} FROM sentences)"
PASSES = f"quality >= 0.4 AND length(text) BETWEEN 4 AND 600 AND len({duck.terms('text')}) > 0 AND NOT {duck.junk('text')}"
ADMITTED = f"""{SENTENCES},
judged AS (SELECT *, {duck.quality('text')} AS quality FROM numbered),
keyed AS (SELECT *, CASE WHEN {PASSES} THEN coalesce('k' || {duck.content_key('text')}, 't' || lower({duck.strip('text')})) END AS key FROM judged),
admitted AS (SELECT *, CASE WHEN key IS NOT NULL THEN min(seq) OVER (PARTITION BY key) END AS origin FROM keyed),
status AS (SELECT doc_id, pos, source, text, seq, quality, CASE WHEN key IS NULL THEN 'rejected' WHEN origin = seq THEN 'kept' ELSE 'duplicate' END AS status, origin FROM admitted),
kept AS (SELECT doc_id, pos, source, text, seq, quality FROM status WHERE status = 'kept')"""


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.numbered(sentences(spark, sf))


def admitted(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.admit(numbered(spark, sf), 0.4)


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return admitted(spark, sf).where("status = 'kept'").select("doc_id", "pos", "source", "text", "seq", "quality")


@query(f"SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY lower({duck.strip('text')}))")
def exact_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.lower(T.strip("text")), 256).alias("key"))
    return corpus.first_wins(docs, "key", "doc_id").select("doc_id", F.col("first").alias("first_id"), "copies")


@query(f"WITH {SENTENCES}, k AS (SELECT seq, {duck.content_key('text')} AS key FROM numbered) SELECT seq, CASE WHEN key IS NULL THEN seq ELSE min(seq) OVER (PARTITION BY key) END AS first_seq FROM k")
def content_key_dedup(spark, sf):
    rows = numbered(spark, sf).select("seq", F.sha2(T.content_key("text"), 256).alias("key"))
    return corpus.first_wins(rows, "key").select("seq", F.coalesce("first", "seq").alias("first_seq"))


@query(f"WITH {ADMITTED} SELECT seq, source, round(quality, 6) AS quality, status, origin FROM status")
def admission(spark, sf):
    return admitted(spark, sf).select("seq", "source", F.round("quality", 6).alias("quality"), "status", "origin")


@query(
    f"""WITH {ADMITTED}, again AS (SELECT s.origin, count(*) AS n, count(DISTINCT s.source) AS others FROM status s JOIN kept k ON s.origin = k.seq WHERE s.status = 'duplicate' AND s.source <> k.source GROUP BY 1)
SELECT seq, 1 + coalesce(others, 0) AS sources, CAST(least(20.0, 0.5 * coalesce(n, 0)) AS DOUBLE) AS score FROM kept LEFT JOIN again ON seq = origin"""
)
def corroboration(spark, sf):
    return corpus.corroborated(admitted(spark, sf)).select("seq", "sources", F.col("score").cast("double").alias("score"))


@query(f"WITH {ADMITTED} SELECT source, status, count(*) AS n, round(avg(quality), 6) AS quality FROM status GROUP BY 1, 2")
def admission_by_source(spark, sf):
    return admitted(spark, sf).groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality"))


@query(f"WITH {SENTENCES} SELECT seq, row_number() OVER (ORDER BY seq) % 40 = 0 AS held_out FROM numbered")
def holdout_split(spark, sf):
    return corpus.holdout(numbered(spark, sf)).select("seq", "held_out")


@query(
    f"""WITH RECURSIVE {duck.sentences()}, s AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, text, count(*) OVER (PARTITION BY doc_id) AS n FROM sentences),
walk AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, '' AS grown, FALSE AS filled, CAST(0 AS BIGINT) AS span FROM s
  UNION ALL SELECT s.doc_id, s.k, CASE WHEN filled THEN '' ELSE grown END || text, length(CASE WHEN filled THEN '' ELSE grown END || text) >= 350, span + CASE WHEN filled THEN 1 ELSE 0 END FROM walk JOIN s ON s.doc_id = walk.doc_id AND s.k = walk.k + 1)
SELECT walk.doc_id, span, grown AS text FROM walk JOIN (SELECT doc_id, max(n) AS n FROM s GROUP BY 1) z ON z.doc_id = walk.doc_id WHERE filled OR (k = n AND length(grown) >= 40)"""
)
def span_packing(spark, sf):
    """A fold over each document's sentences."""
    return corpus.spans(sentences(spark, sf)).withColumn("span", F.col("span").cast("long"))


@query(f"WITH {SENTENCES} SELECT seq, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS next_text FROM numbered")
def adjacent_sentences(spark, sf):
    return corpus.neighbours(numbered(spark, sf)).select("seq", "next_text")


@query(f"WITH {SENTENCES}, sized AS (SELECT seq, length(text) AS size FROM numbered WHERE length(text) <= 25000), used AS (SELECT seq, sum(size) OVER (ORDER BY seq DESC) AS used FROM sized) SELECT seq FROM used WHERE used <= 100000")
def ring_retention(spark, sf):
    return corpus.newest_within(numbered(spark, sf), F.length("text"), 100_000, block=-F.floor(F.col("doc_id") / 64)).select("seq")


@query(f"WITH {ADMITTED}, r AS (SELECT seq, source, row_number() OVER (PARTITION BY source ORDER BY quality DESC, seq) AS turn FROM kept WHERE length(text) BETWEEN 8 AND 300) SELECT seq, source, turn FROM r ORDER BY turn, source LIMIT 300")
def source_round_robin(spark, sf):
    some = kept(spark, sf).where(F.length("text").between(8, 300))
    return corpus.round_robin(some, "source", [F.desc("quality"), F.asc("seq")], 300).select("seq", "source", F.col("turn").cast("long").alias("turn"))


@query(
    f"""WITH {ADMITTED}, worth AS (SELECT k.seq, 200 + 2 * length(k.text) + 60 * len(list_distinct({duck.terms('k.text')})) AS bytes,
round(coalesce(l.quality, 0) + CASE WHEN k.source = 'golden' THEN 0 ELSE 0 END + k.quality - 0.2 * (k.doc_id % 10), 6) AS worth FROM kept k LEFT JOIN labels l USING (doc_id)),
ran AS (SELECT seq, worth, bytes, sum(bytes) OVER (ORDER BY worth DESC, seq) AS used FROM worth) SELECT seq, worth, CAST(bytes AS BIGINT) AS bytes FROM ran WHERE used <= 3000000"""
)
def evict_budget(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("score"))
    rows = kept(spark, sf).join(labels, "doc_id", "left")
    worth = corpus.keep_score(F.coalesce("score", F.lit(0)), F.col("source"), F.col("quality"), F.lit(0), F.col("doc_id") % 10)
    size = (200 + 2 * F.length("text") + 60 * F.size(F.array_distinct(T.terms("text")))).cast("long")
    rows = rows.select("seq", F.round(worth, 6).alias("worth"), size.alias("bytes"))
    # blocks of like worth follow the keep-order
    ran = corpus.running_sum(rows, -F.floor(F.col("worth") * 100), [F.desc("worth"), F.asc("seq")], F.col("bytes"), "used")
    return ran.where("used <= 3000000").select("seq", "worth", "bytes")


@query("SELECT doc_id FROM documents ORDER BY md5('seed' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def random_documents(spark, sf):
    return corpus.sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 50)


POSTINGS = f"""{ADMITTED}, bags AS (SELECT seq, unnest({duck.terms('text')}) AS term FROM kept), postings AS (SELECT seq, term, least(count(*), 255) AS tf FROM bags GROUP BY 1, 2)"""


@query(f"WITH {POSTINGS} SELECT seq, term, tf FROM postings")
def term_frequency(spark, sf):
    return index.postings(kept(spark, sf))


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df FROM postings GROUP BY 1")
def document_frequency(spark, sf):
    return index.document_frequency(index.postings(kept(spark, sf)))


@query(f"WITH {POSTINGS} SELECT count(DISTINCT seq) AS docs, count(DISTINCT term) AS terms, sum(tf) AS length, round(sum(tf) / count(DISTINCT seq), 6) AS mean_length FROM postings")
def corpus_stats(spark, sf):
    posted = index.postings(kept(spark, sf))
    by_doc = posted.groupBy("seq").agg(F.sum("tf").alias("dl")).agg(F.count(F.lit(1)).alias("docs"), F.sum("dl").alias("length"))
    terms = index.document_frequency(posted).agg(F.count(F.lit(1)).alias("terms"))
    return by_doc.join(F.broadcast(terms), F.lit(True)).select("docs", "terms", "length", F.round(F.col("length") / F.col("docs"), 6).alias("mean_length"))


@query(f"WITH {POSTINGS}, df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1) SELECT term FROM df WHERE df <= 2 AND {duck.is_phrase('term')} ORDER BY md5('seed' || term), term LIMIT 40")
def sparse_terms(spark, sf):
    df = index.document_frequency(index.postings(kept(spark, sf)))
    return corpus.sample(df.where((F.col("df") <= 2) & T.is_phrase(F.col("term"))).select("term"), "term", 40)


_REMOVED = "doc_id % 7 = 0"


@query(
    f"""WITH {POSTINGS}, added AS (SELECT seq, term, 300 AS tf FROM postings WHERE length(term) >= 12), gone AS (SELECT seq FROM kept WHERE {_REMOVED}),
both_of AS (SELECT seq, term, tf, 0 AS v FROM postings UNION ALL SELECT seq, term, tf, 1 FROM added)
SELECT seq, term, CAST(least(max_by(tf, v), 255) AS BIGINT) AS tf FROM both_of WHERE seq NOT IN (SELECT seq FROM gone) GROUP BY seq, term"""
)
def postings_maintenance(spark, sf):
    """Upserts with a cap, and deletes by anti-join."""
    rows = kept(spark, sf)
    old = index.postings(rows)
    return index.merge_postings(old, old.where(F.length("term") >= 12).withColumn("tf", F.lit(300).cast("long")), rows.where(_REMOVED)).withColumn("tf", F.col("tf").cast("long"))


# n-grams: of all sentences, each 40th held out

TOKENS = duck.matches("lower(text)", K.WORD)
EVENTS = f"""{SENTENCES}, split AS (SELECT seq, text, row_number() OVER (ORDER BY seq) % 40 = 0 AS held_out FROM numbered),
ids AS (SELECT seq, held_out, ['<s>'] || {TOKENS} || ['</s>'] AS t FROM split),
ev AS (
  SELECT 0 AS n, '' AS ctx, t[i] AS tok FROM (SELECT t, unnest(range(2, len(t) + 1)) AS i FROM ids WHERE NOT held_out)
  UNION ALL SELECT 1, t[i - 1], t[i] FROM (SELECT t, unnest(range(2, len(t) + 1)) AS i FROM ids WHERE NOT held_out AND len(t) - 1 >= 2)
  UNION ALL SELECT 2, t[i - 2] || ' ' || t[i - 1], t[i] FROM (SELECT t, unnest(range(3, len(t) + 1)) AS i FROM ids WHERE NOT held_out AND len(t) - 1 >= 3)
), counts AS (SELECT n, ctx, tok, count(*) AS c FROM ev GROUP BY 1, 2, 3),
heads AS (SELECT n, ctx, sum(c) AS total, count(*) AS types FROM counts GROUP BY 1, 2),
cont AS (SELECT tok, count(*) AS cont FROM counts WHERE n = 1 GROUP BY 1)"""


def counted(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.holdout(numbered(spark, sf)).where("NOT held_out")
    return ngrams.corpus_counts(rows)


@query(f"WITH {EVENTS} SELECT CAST(n AS BIGINT) AS n, ctx, tok, c FROM counts")
def ngram_counts(spark, sf):
    return counted(spark, sf).withColumn("n", F.col("n").cast("long"))


@query(f"WITH {EVENTS} SELECT tok, cont FROM cont")
def kn_continuation(spark, sf):
    return ngrams.continuations(counted(spark, sf))


@query(f"WITH {EVENTS} SELECT CAST(n AS BIGINT) AS n, ctx, CAST(total AS BIGINT) AS total, types FROM heads")
def ngram_contexts(spark, sf):
    return ngrams.contexts(counted(spark, sf)).withColumn("n", F.col("n").cast("long"))


@query(f"WITH {EVENTS}, k AS (SELECT * FROM counts WHERE n = 0 OR c >= 2) SELECT CAST(n AS BIGINT) AS n, count(*) AS entries, count(DISTINCT ctx) AS contexts, CAST(sum(c) AS BIGINT) AS total FROM k GROUP BY 1")
def ngram_prune(spark, sf):
    left = ngrams.prune(counted(spark, sf), 2)
    by_context = left.groupBy("n", "ctx").agg(F.count(F.lit(1)).alias("e"), F.sum("c").alias("t"))
    return by_context.groupBy(F.col("n").cast("long").alias("n")).agg(F.sum("e").alias("entries"), F.count(F.lit(1)).alias("contexts"), F.sum("t").alias("total"))


PERPLEXITY = f"""{EVENTS}, sums AS (SELECT coalesce(sum(cont), 0) AS cont_total, (SELECT count(*) + 3 FROM counts WHERE n = 0) AS v FROM cont),
asked AS (SELECT seq, t, i, t[i] AS tok, CASE WHEN i > 1 THEN t[i - 1] END AS c1, CASE WHEN i > 2 THEN t[i - 2] || ' ' || t[i - 1] END AS c2 FROM (SELECT seq, t, unnest(range(2, len(t) + 1)) AS i FROM ids WHERE held_out)),
p0 AS (SELECT a.*, (coalesce(cont.cont, 0) + 1.0) / (cont_total + v) AS p FROM asked a LEFT JOIN cont ON a.tok = cont.tok, sums),
p1 AS (SELECT p0.* EXCLUDE (p), CASE WHEN h.total IS NULL THEN p ELSE greatest(coalesce(c.c, 0) - D, 0) / h.total + D * h.types / h.total * p END AS p
  FROM p0 LEFT JOIN heads h ON h.n = 1 AND h.ctx = c1 LEFT JOIN counts c ON c.n = 1 AND c.ctx = c1 AND c.tok = p0.tok),
p2 AS (SELECT p1.* EXCLUDE (p), CASE WHEN h.total IS NULL THEN p ELSE greatest(coalesce(c.c, 0) - D, 0) / h.total + D * h.types / h.total * p END AS p
  FROM p1 LEFT JOIN heads h ON h.n = 2 AND h.ctx = c2 LEFT JOIN counts c ON c.n = 2 AND c.ctx = c2 AND c.tok = p1.tok)"""


def held_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_model.held_counts(ngram_model.holdout_rows(numbered(spark, sf)))


def held_probabilities(spark: SparkSession, sf: str, orders: int = 3, discount: float = K.DISCOUNT) -> DataFrame:
    return held_counts(spark, sf).select("seq", "i", "tok", ngram_model.probability(orders, discount).alias("p"))


@query(f"WITH {PERPLEXITY} SELECT count(*) AS tokens, round(exp(-avg(ln(greatest(p, 1e-12)))), 4) AS perplexity FROM p2".replace("D *", "0.75 *").replace("- D,", "- 0.75,"))
def ngram_perplexity(spark, sf):
    return held_probabilities(spark, sf).agg(F.count(F.lit(1)).alias("tokens"), F.round(ngrams.perplexity(F.col("p")), 4).alias("perplexity"))


@query(f"WITH {PERPLEXITY} SELECT seq, CAST(i - 1 AS BIGINT) AS i, tok, round(p, 9) AS p FROM p2".replace("D *", "0.75 *").replace("- D,", "- 0.75,"))
def ngram_probability(spark, sf):
    return held_probabilities(spark, sf).select("seq", F.col("i").cast("long").alias("i"), "tok", F.round("p", 9).alias("p"))


def _grid(orders: int, discount: float) -> str:
    p = "p2" if orders == 3 else "p1"
    sql = PERPLEXITY.replace("D *", f"{discount} *").replace("- D,", f"- {discount},")
    return f"SELECT * FROM (WITH {sql} SELECT CAST({orders} AS BIGINT) AS orders, CAST({discount} AS DOUBLE) AS discount, round(exp(-avg(ln(greatest(p, 1e-12)))), 4) AS perplexity FROM {p})"


@query(" UNION ALL ".join(_grid(o, d) for o in (2, 3) for d in (0.5, 0.9)))
def order_grid(spark, sf):
    """Perplexity by order and discount, all of the same counts."""
    grid = [(o, d) for o in (2, 3) for d in (0.5, 0.9)]
    ppl = lambda o, d: F.round(ngrams.perplexity(ngram_model.probability(o, d)), 4)
    each = held_counts(spark, sf).agg(*[ppl(o, d).alias(f"p{k}") for k, (o, d) in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(o).cast("long").alias("orders"), F.lit(d).alias("discount"), F.col(f"p{k}").alias("perplexity")) for k, (o, d) in enumerate(grid)])
    return each.select(F.inline(rows))


@query(f"WITH {EVENTS}, r AS (SELECT ctx, tok, c, row_number() OVER (PARTITION BY ctx ORDER BY c DESC, tok) AS rank FROM counts WHERE n = 1) SELECT ctx, tok, c, rank FROM r WHERE rank <= 5")
def next_token_candidates(spark, sf):
    return ngrams.top_next(counted(spark, sf), 1, 5)


@query(f"WITH {EVENTS} SELECT c.ctx, c.tok, round(c / total, 6) AS p FROM counts c JOIN heads USING (n, ctx) WHERE n = 2")
def backoff_probability(spark, sf):
    return ngrams.backoff(counted(spark, sf), 3)


_WORDS = duck.matches("lower(text)", K.WORD)


@query(
    f"""WITH {SENTENCES}, h AS (SELECT item_id AS id, {_WORDS}[1:8] AS h FROM benchmark), b AS (SELECT {_WORDS} || ['</s>'] AS t FROM numbered),
pos AS (SELECT t, unnest(range(2, len(t))) AS i FROM b WHERE len(t) > 2),
m AS (SELECT id, h, t, i FROM pos JOIN h ON t[i] = h[-1] AND t[i - 1] = h[-2] AND len(h) >= 2),
l AS (SELECT id, t[i + 1] AS next, list_max(list_filter(range(2, least(12, i, len(h)) + 1), lambda k: t[i - k + 1:i] = h[len(h) - k + 1:len(h)])) AS length FROM m),
best AS (SELECT id, max(length) AS length FROM l GROUP BY 1)
SELECT id, CAST(length AS BIGINT) AS length, next, count(*) AS n FROM l JOIN best USING (id, length) GROUP BY ALL"""
)
def longest_match_continuation(spark, sf):
    """What follows the longest end of each benchmark item's first eight tokens."""
    starts = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.array_join(F.slice(T.all_matches(F.lower("text"), K.WORD), 1, 8), " ").alias("text"))
    return ngrams.longest_continuations(starts, numbered(spark, sf))


_RUNS = rf"[a-z0-9]+|[{K.KANJI}]+|[{K.KANA}]+"
_SUBWORDS = f"""{SENTENCES}, runs AS (SELECT unnest(regexp_extract_all(lower(text), '{_RUNS}')) AS r FROM numbered),
grams AS (SELECT substr(r, i, k) AS gram FROM (SELECT r, k, unnest(range(1, length(r) - k + 2)) AS i FROM (SELECT r, unnest(range(2, least(4, length(r)) + 1)) AS k FROM runs WHERE length(r) >= 2))),
units AS (SELECT gram, count(*) AS n FROM grams GROUP BY 1)"""


@query(f"WITH {_SUBWORDS} SELECT gram, CAST(n * (length(gram) - 1) AS BIGINT) AS score FROM units WHERE n >= 2 ORDER BY score DESC, gram DESC LIMIT 500")
def subword_vocabulary(spark, sf):
    return ngrams.subword_vocabulary(numbered(spark, sf))


@query(f"WITH {_SUBWORDS}, v AS (SELECT gram FROM units WHERE n >= 2 ORDER BY n * (length(gram) - 1) DESC, gram DESC LIMIT 500) SELECT gram, n FROM units WHERE n >= 5 AND gram NOT IN (SELECT gram FROM v) ORDER BY n * (length(gram) - 1) DESC, gram LIMIT 100")
def new_subword_units(spark, sf):
    rows = numbered(spark, sf)
    units = ngrams.subword_counts(rows).where("n >= 5")
    fresh = units.join(F.broadcast(ngrams.subword_vocabulary(rows).select("gram")), "gram", "left_anti")
    return fresh.orderBy(F.desc(F.col("n") * (F.length("gram") - 1)), "gram").limit(100)


@query(
    f"""WITH {SENTENCES}, p AS (SELECT {duck.phrases('text')} AS p FROM numbered), i AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p WHERE len(p) >= 2),
j AS (SELECT p, i, unnest(range(greatest(i - 3, 1), least(i + 3, len(p)) + 1)) AS j FROM i)
SELECT p[i] AS term, p[j] AS neighbour, CAST(sum(CASE WHEN abs(i - j) = 1 THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM j WHERE i <> j GROUP BY 1, 2"""
)
def cooccurrence(spark, sf):
    return ngrams.cooccurrence(numbered(spark, sf))


@query(f"WITH {SENTENCES}, t AS (SELECT DISTINCT unnest({TOKENS}) AS tok FROM numbered) SELECT tok, row_number() OVER (ORDER BY tok) + 2 AS id FROM t")
def token_ids(spark, sf):
    """Dense ids after the three special ones."""
    toks = numbered(spark, sf).select(F.explode(T.all_matches(F.lower("text"), K.WORD)).alias("tok")).distinct()
    numbered_ = corpus.running_sum(toks, F.ascii("tok"), ["tok"], F.lit(1), "k")
    return numbered_.select("tok", (F.col("k") + 2).alias("id"))
