"""Queries of training sequences, held-out sets, examples, feedback, generation and parameter search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import corpus, dialogs, ngrams, search, training, transformer
from corpusmill.operators.store import stored
from corpusmill.plans import duck, golden
from corpusmill.plans.corpus_queries import ADMITTED, SENTENCES, counted, kept, numbered
from corpusmill.plans.registry import query, table
from corpusmill.plans.retrieval_queries import asked

WIDTH = 128


@query()
def dialog_sequences(spark, sf):
    """Pairs with the two pairs before them as token sequences; a loop in the tests makes the same ones."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    rows = dialogs.pairs(table(spark, sf, "conversations")).withColumns({"u": T.tokenize("user"), "b": T.tokenize("bot")})
    rows = rows.withColumn("before", F.collect_list(F.struct(F.col("u").alias("user"), F.col("b").alias("bot"))).over(w))
    made = training.dialog_sequence(F.array().cast("array<string>"), F.col("before"), F.col("u"), F.col("b"), WIDTH)
    times = training.repeats(F.lit(1.0), F.size("before") > 0)
    return rows.select("conv_id", "turn", made.alias("s"), times.alias("times")).select("conv_id", "turn", F.array_join("s.ids", " ").alias("ids"), F.col("s.loss_from").cast("long").alias("loss_from"), "times")


@query(
    f"""WITH {SENTENCES}, h AS (SELECT seq, substr(md5(CAST(seq AS VARCHAR)), 1, 2) < '05' AS held FROM numbered),
a AS (SELECT seq FROM h WHERE held ORDER BY seq LIMIT 300), b AS (SELECT seq FROM h WHERE held AND seq NOT IN (SELECT seq FROM a) ORDER BY seq DESC LIMIT 150)
SELECT seq, CASE WHEN NOT held THEN 'train' WHEN seq IN (SELECT seq FROM a) THEN 'fixed' WHEN seq IN (SELECT seq FROM b) THEN 'rotating' ELSE 'past' END AS part FROM h"""
)
def training_parts(spark, sf):
    return training.parts(numbered(spark, sf))


@query()
def training_chunks(spark, sf):
    """Paragraphs of good prose as sequences; a loop in the tests makes the same ones."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(training.chunks(F.coalesce("text", F.lit("")), WIDTH)).alias("pos", "ids"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join("ids", " ").alias("ids"))


@query(
    f"""WITH {ADMITTED}, n AS (SELECT seq, text, {duck.keywords('text', 1)}[1] AS key, lag(text) OVER w AS b, lead(text) OVER w AS a FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
o AS (SELECT *, list_filter([b, a], lambda x: x IS NOT NULL) AS others FROM n WHERE key IS NOT NULL),
p AS (SELECT *, CAST('0x' || substr(md5(CAST(seq AS VARCHAR)), 1, 4) AS INT) % (len(others) + 1) AS spot FROM o)
SELECT seq, key || 'について教えて' AS question, array_to_string(others[1:spot] || [text] || others[spot + 1:len(others)], ' ') AS context, text AS answer FROM p"""
)
def copy_examples(spark, sf):
    return training.copy_examples(kept(spark, sf))


@query("SELECT user_id AS id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN CAST(user_id % 2 = 0 AS DOUBLE) ELSE 0.0::DOUBLE END AS label FROM events WHERE event_type = 'purchase' OR user_id % 2 = 0")
def feedback_labels(spark, sf):
    """Events as candidates, purchases as what was used; users with an even id are content."""
    rows = table(spark, sf, "events").selectExpr("user_id AS id", "event_id AS seq", "event_type")
    verdicts = rows.select("id", (F.col("id") % 2 == 0).alias("positive")).distinct()
    return training.feedback_labels(rows.select("id", "seq"), rows.where("event_type = 'purchase'").select("id", "seq"), verdicts)


@query(
    "WITH g AS (SELECT user_id, event_type = 'purchase' AS p, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 12 AS g FROM events), r AS (SELECT user_id, g, avg(p::DOUBLE) AS rate FROM g GROUP BY 1, 2 HAVING count(*) = 12), "
    "m AS (SELECT *, max(rate) OVER (PARTITION BY user_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM r) SELECT user_id, count(*) AS decisions, count(*) FILTER (rate < mark) AS reverted, round(max(rate), 6) AS best FROM m GROUP BY 1"
)
def decode_climb(spark, sf):
    return training.climbed(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "purchase")


@query()
def diverse_summary(spark, sf):
    """Up to three of the eight best sentences, each with something new; a loop in the tests chooses the same ones."""
    rows = stored(kept(spark, sf), "kept")
    hits = search.bm25(rows, asked(spark, sf), 8).join(rows.select("seq", "source", "text"), "seq")
    return training.diverse(hits).select("id", F.array_join(F.col("seqs").cast("array<string>"), ",").alias("seqs"))


_GP = r"regexp_replace(lower(t), '\s+', '', 'g')"
_GRAMS = f"list_filter(list_transform(range(1, greatest(length(p), 1)), lambda i: substr(p, i, 2)), lambda x: NOT regexp_matches(x, '[、。，．,.!?！？「」『』()（）・]'))"
_EITHER = "CASE WHEN len(g) = 0 AND p <> '' THEN [p] ELSE g END"


@query(
    f"""WITH {SENTENCES}, d AS (SELECT seq, {_EITHER} AS g FROM (SELECT seq, p, {_GRAMS} AS g FROM (SELECT seq, {_GP} AS p FROM (SELECT seq, text AS t FROM numbered)))), st AS (SELECT count(*) AS n, avg(len(g)) AS mean FROM d),
q AS (SELECT id, unnest(g) AS gram, len(g) AS size FROM (SELECT id, list_distinct({_EITHER}) AS g FROM (SELECT id, p, {_GRAMS} AS g FROM (SELECT i AS id, {_GP} AS p FROM ({golden.values(golden.QUESTIONS)}) v(i, t))))),
p AS (SELECT gram, seq, dl, count(*) AS tf FROM (SELECT seq, len(g) AS dl, unnest(g) AS gram FROM d) WHERE gram IN (SELECT gram FROM q) GROUP BY 1, 2, 3),
df AS (SELECT gram, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT id, seq, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.4 + 0.6 * dl / mean))), 6) AS score FROM q JOIN p USING (gram) JOIN df USING (gram), st WHERE df <= n * 0.2 OR size <= 2 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, seq) AS rank, round(score / max(score) OVER (PARTITION BY id), 6) AS rel FROM s)
SELECT id, seq, score, rel, rank FROM r WHERE rank <= 3"""
)
def gram_search(spark, sf):
    """The three best sentences for each golden question by pairs of characters."""
    return search.gram_search(numbered(spark, sf), golden.frame(spark, golden.QUESTIONS, "id"))


@query()
def grounded_context(spark, sf):
    rows = stored(numbered(spark, sf), "numbered")
    questions = golden.frame(spark, golden.QUESTIONS, "id")
    hits = search.gram_search(rows, questions).join(rows.select("seq", "text"), "seq")
    return search.grounded(hits, questions)


@query()
def generate(spark, sf):
    """Ten words after the first word of each benchmark item and golden question, by the five most frequent next words."""
    words = asked(spark, sf).select("id", F.slice(T.tokenize("text"), 1, 1).alias("words")).where(F.size("words") > 0)
    made = training.generated(words, ngrams.top_next(counted(spark, sf), 1, 5), 10)
    return made.select("id", T.detokenize("words").alias("text"))


@query()
def evolution(spark, sf):
    """Three generations of search for the discount under which held-out word pairs are likeliest."""
    rows = stored(corpus.holdout(numbered(spark, sf)), "holdout")
    made = stored(ngrams.corpus_counts(rows.where("NOT held_out"), 2), "counts")
    heads = ngrams.contexts(made.where("n = 1")).select("ctx", "total", "types")
    single = made.where("n = 0").select("tok", F.col("c").alias("c0"))
    asked_ = ngrams.counts(ngrams.events(rows.where("held_out"), 2)).where("n = 1").select("ctx", "tok", F.col("c").alias("m"))
    all_ = single.agg(F.sum("c0").alias("c_all"))
    seen = asked_.join(heads, "ctx").join(single, "tok").join(made.where("n = 1").select("ctx", "tok", "c"), ["ctx", "tok"], "left").join(F.broadcast(all_), F.lit(True))
    seen = stored(seen.fillna(0, ["c"]), "asked")

    def fitness(p):
        d = p["discount"]
        chance = F.greatest(F.col("c") - d, F.lit(0.0)) / F.col("total") + d * F.col("types") / F.col("total") * F.col("c0") / F.col("c_all")
        return F.sum(F.col("m") * F.log(chance)) / F.sum("m")

    log = training.evolve(seen, fitness, {"discount": 0.5}, generations=3)
    return spark.createDataFrame([tuple(r[k] for k in ("generation", "accepted", "before", "after", "sigma", "discount")) for r in log], "generation long, accepted boolean, before double, after double, sigma double, discount double")


# A small decoder over the conversations' pairs, in characters.

_SPECIAL = {"pad": 0, "bos": 1, "eos": 2, "usr": 3, "bot": 4}


def _dialog_ids(spark, sf):
    """id, head, ids, loss_from, weight, held of each window of each whole pair, and the pieces; a window begins with the last id of the one before, so each id is foretold once; characters beyond the 300 most frequent are dropped."""
    rows = stored(dialogs.pairs(table(spark, sf, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lower("user").alias("u"), F.lower("bot").alias("b")), "pairs")
    letters = rows.select(F.explode(F.split(F.concat("u", "b"), "")).alias("x")).where("x != ''").groupBy("x").count().orderBy(F.desc("count"), "x").limit(300)
    pieces = [r.x for r in letters.collect()]  # 300 at most
    known = F.create_map(*[F.lit(v) for i, p in enumerate(pieces) for v in (p, i + len(_SPECIAL))]) if pieces else F.expr("map('', 0)")
    one = lambda c: F.filter(F.transform(F.split(c, ""), lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull())
    mark = lambda m: F.array(F.lit(_SPECIAL[m]))
    head = F.concat(mark("bos"), mark("usr"), one("u"), mark("bot"))
    ids = rows.select("id", head.alias("head"), one("b").alias("b"))
    whole = ids.select("id", "head", F.concat("head", "b", mark("eos")).alias("all"))
    cut = whole.select("id", "head", "all", F.explode(F.sequence(F.lit(0), F.size("all") - 2, F.lit(WIDTH - 1))).alias("at"))
    made = cut.select("id", "head", "at", F.slice("all", F.col("at") + 1, WIDTH).alias("ids"), F.greatest(F.lit(0), F.size("head") - F.col("at")).alias("loss_from"), F.lit(1.0).alias("weight"))
    held = F.substring(F.md5(F.col("id").cast("string")), 1, 1) < "1"
    return stored(made.withColumn("held", held), "dialog-ids"), pieces


def _trained(spark, sf):
    rows, pieces = _dialog_ids(spark, sf)
    shape = transformer.Shape(len(pieces) + len(_SPECIAL))
    start = transformer.fresh(shape)
    return rows, pieces, shape, start, transformer.train(rows.where("NOT held"), start, shape, rounds=2)


@query()
def decoder_training(spark, sf):
    """Nats a token of each pair before and after two rounds of training; each pair by its own place, a sixteenth held out."""
    rows, _, shape, start, w = _trained(spark, sf)
    mean = lambda n: F.round(F.sum(F.col("tokens") * F.col(n)) / F.sum("tokens"), 4).alias(n)
    scored = transformer.scored_by(rows, {"before": start, "after": w}, shape).groupBy("id").agg(mean("before"), mean("after"), F.sum("tokens").alias("tokens"))
    return rows.where("at = 0").select("id", "held").join(scored.select("id", "tokens", "before", "after"), "id")


@query()
def decoder_replies(spark, sf):
    """Up to 24 characters in reply to each held-out request."""
    rows, pieces, shape, _, w = _trained(spark, sf)
    made = transformer.continued(rows.where("held AND at = 0").select("id", F.col("head").alias("ids")), w, shape, new=24, end=_SPECIAL["eos"], copy_bonus=0.5)
    said = F.array(*map(F.lit, [""] * len(_SPECIAL) + pieces))
    return made.select("id", F.array_join(F.transform("ids", lambda i: F.get(said, i)), "").alias("reply"))
