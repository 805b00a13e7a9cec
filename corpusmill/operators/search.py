"""Batch BM25 search and what ranks, widens and judges its hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed as K
from corpusmill.functions import text as T
from corpusmill.operators import folds
from corpusmill.operators.store import stored


#: Postings of the rarest terms that give a query's first hits, for each hit that is wanted.
SEEDS = 100
#: Scores are rounded, and sums of floating numbers depend on their order.
MARGIN = 1e-4
#: The factor of the best quality.
MOST_QUALITY = 1.15


def query_terms(queries: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """id, term, qw (how often the query says it, two at most, or the weight of an extra term), tw, own, total_w."""
    said = queries.select("id", F.explode_outer(T.terms("text")).alias("term")).where("term is not null").groupBy("id", "term").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("double").alias("qw"))
    said = said.withColumn("own", F.lit(True))
    if extra is not None:
        more = extra.select("id", "term", "qw", F.lit(False).alias("own")).join(said.select("id", "term"), ["id", "term"], "left_anti")
        said = said.unionByName(more)
    said = said.withColumn("tw", T.term_weight(F.col("term")))
    return said.withColumn("total_w", F.sum(F.when(F.col("own"), F.col("tw")).otherwise(0.0)).over(Window.partitionBy("id")))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, extra: DataFrame | None = None, k1: float = K.K1, b: float = K.B, phrase_bonus: float = K.PHRASE_BONUS) -> DataFrame:
    """id, seq, score, cover, rank: the ``k`` best of ``docs`` (seq, text, quality) for each query (id, text).

    Only postings of terms that some query has are counted and shuffled. Terms in more than a fifth of the sentences
    count only where a query has no other. Hits are exact: a sentence is left out only if all its terms together cannot
    reach the score of the ``k``-th of the sentences that hold the query's rarest terms.
    """
    asked = stored(query_terms(queries, extra), "query-terms")
    bags = stored(docs.select("seq", "quality", T.terms("text").alias("t")).where(F.size("t") > 0), "bags")
    sums = bags.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avgdl"))
    wanted = asked.select("term").distinct()
    hits = bags.select("seq", "quality", F.size("t").alias("dl"), F.explode("t").alias("term")).join(wanted, "term", "left_semi")
    posted = hits.groupBy("term", "seq", "quality", "dl").agg(F.least(F.count(F.lit(1)), F.lit(255)).alias("tf"))
    posted = stored(posted, "postings")
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = asked.join(df, "term").join(F.broadcast(sums), F.lit(True))
    limit = F.greatest(F.lit(K.STOP_FLOOR), F.floor(F.col("n") * K.STOP_RATIO))
    known = known.withColumn("rare", F.col("df") <= limit).withColumn("some", F.max("rare").over(Window.partitionBy("id"))).where(F.col("rare") | ~F.col("some"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    long = (F.length("term") >= 3) | ((F.length("term") == 2) & ~F.col("term").rlike(r"^[\x{3040}-\x{30FF}]{2}$"))
    known = known.withColumn("w", idf * F.col("tw") * F.when(long, phrase_bonus).otherwise(1.0) * F.col("qw"))
    known = stored(known.select("id", "term", "w", "tw", "own", "total_w", "df", "avgdl"), "known-terms")
    saturated = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))

    own_weight = F.when(F.col("own"), F.col("tw")).otherwise(0.0)
    whole = F.when(F.col("total_w") > 0, F.col("total_w")).otherwise(1.0)
    by_quality = 0.85 + 0.3 * F.col("quality")

    def sums_of(each: DataFrame) -> DataFrame:
        return each.groupBy("id", "seq", "quality", "total_w").agg(F.sum(F.col("w") * saturated).alias("s"), F.sum(own_weight).alias("c"))

    def best(pairs: DataFrame) -> DataFrame:
        """The ``k`` best of (id, seq), by all known terms."""
        sums = sums_of(pairs.join(posted, "seq").join(known, ["id", "term"]))
        sums = sums.withColumn("cover", F.round(F.col("c") / whole, 6)).withColumn("score", F.round(F.col("s") * (0.5 + F.col("c") / whole) * by_quality, 6))
        ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "seq")))
        return ranked.where(F.col("rank") <= k).select("id", "seq", "score", "cover", F.col("rank").cast("long").alias("rank"))

    # the k best of the sentences with a query's rarest terms give a score that hits must reach
    before = F.sum("df").over(Window.partitionBy("id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
    rarest = known.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SEEDS * k)
    first = best(rarest.select("id", "term").join(posted.select("term", "seq"), "term").select("id", "seq").distinct())
    least = stored(first.where(F.col("rank") == k).select("id", F.col("score").alias("least")), "least-scores")
    # a query's lightest terms that together cannot reach it: sentences that have no other term are not scored
    lighter = Window.partitionBy("id").orderBy("w", "term").rowsBetween(Window.unboundedPreceding, 0)
    most = (k1 + 1) * F.sum("w").over(lighter) * (0.5 + F.sum(own_weight).over(lighter) / whole) * MOST_QUALITY
    parted = known.withColumn("most", most).join(least, "id", "left").withColumn("needed", F.col("least").isNull() | (F.col("most") + MARGIN >= F.col("least")))
    parted = stored(parted, "parted-terms")
    rest = parted.groupBy("id").agg(F.max("least").alias("least"), F.sum(F.when(F.col("needed"), 0.0).otherwise(F.col("w"))).alias("rest_w"), F.sum(F.when(F.col("needed"), 0.0).otherwise(own_weight)).alias("rest_c"))
    # nor are those whose other terms fall short even with all the light ones
    partial = sums_of(parted.where("needed").join(posted, "term")).join(rest, "id")
    reach = (F.col("s") + (k1 + 1) * F.col("rest_w")) * (0.5 + (F.col("c") + F.col("rest_c")) / whole) * by_quality
    return best(partial.where(F.col("least").isNull() | (reach + MARGIN >= F.col("least"))).select("id", "seq"))


def gram_search(docs: DataFrame, queries: DataFrame, k: int = 3, k1: float = K.K1, b: float = K.B) -> DataFrame:
    """id, seq, score, rel, rank: BM25 over pairs of characters, for texts without word boundaries; rel is relative to the best.

    Pairs in over a fifth of the texts count only for queries of at most two pairs.
    """
    asked = stored(queries.select("id", F.explode(F.array_distinct(T.character_grams("text"))).alias("gram")).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("id"))), "query-grams")
    bags = stored(docs.select("seq", T.character_grams("text").alias("g")), "grams")
    sums = bags.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("g")).alias("mean"))
    hits = bags.select("seq", F.size("g").alias("dl"), F.explode("g").alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    posted = stored(hits.groupBy("gram", "seq", "dl").agg(F.count(F.lit(1)).alias("tf")), "gram-postings")
    known = asked.join(posted.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram").join(F.broadcast(sums), F.lit(True))
    known = known.where((F.col("df") <= F.col("n") * K.STOP_RATIO) | (F.col("size") <= 2))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    scored = known.join(posted, "gram").groupBy("id", "seq").agg(F.round(F.sum(weight), 6).alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "seq")
    ranked = scored.withColumns({"rank": F.row_number().over(w).cast("long"), "rel": F.round(F.col("score") / F.max("score").over(Window.partitionBy("id")), 6)})
    return ranked.where(F.col("rank") <= k).select("id", "seq", "score", "rel", "rank")


def grounded(hits: DataFrame, queries: DataFrame, most: int = 200) -> DataFrame:
    """id, context, off_topic: the texts of a query's hits (id, rank, text), those that say its key words first.

    The longest key must occur if it has four characters; else any does. If no hit says a key there is no context.
    """
    keys = F.filter(T.all_matches(F.lower("text"), K.KEY_RUN), lambda x: ~x.isin(*K.GENERIC_KEYS))
    asked = queries.select("id", keys.alias("keys"))
    lists = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("h"))
    longest = F.reduce("keys", F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    needed = F.when(F.length("longest") >= 4, F.array("longest")).otherwise(F.col("keys"))
    says = lambda t: (F.size("keys") == 0) | F.exists("needed", lambda key: F.exists(F.concat(F.array(key), F.filter(F.split(key, "・"), lambda x: F.length(x) >= 2)), lambda x: F.instr(t, x) > 0))
    rows = asked.join(lists, "id").withColumn("longest", longest).withColumn("needed", needed)
    rows = rows.withColumns({"on": F.filter("h", lambda x: says(x["text"])), "off": F.filter("h", lambda x: ~says(x["text"]))})
    joined = F.array_join(F.transform(F.concat("on", "off"), lambda x: x["text"]), " ")
    return rows.select("id", F.when(F.size("on") > 0, F.substr(joined, F.lit(1), F.lit(most))).alias("context"), (F.size("on") == 0).alias("off_topic"))


def confidence(score: Column, cover: Column, penalty: float = 1.0) -> Column:
    return (0.65 * cover + 0.35 * (1 - F.exp(-score / 6))) * penalty


def first_hits(*hits: DataFrame) -> DataFrame:
    """The union of hit lists; of several hits on a sentence the earliest list's stands."""
    out = None
    for i, h in enumerate(hits):
        part = h.withColumn("list", F.lit(i))
        out = part if out is None else out.unionByName(part)
    best = F.row_number().over(Window.partitionBy("id", "seq").orderBy("list"))
    return out.withColumn("k", best).where("k = 1").drop("k")


def pseudo_query(text: Column, words: int = 3) -> Column:
    """Every other phrase of a sentence, the first ``words`` of them; null if it has none."""
    some = lambda p: F.slice(F.filter(p, lambda _, i: i % 2 == 0), 1, words)
    return T.let(T.phrases(text), lambda p: F.when(F.size(p) > 0, F.array_join(some(p), " ")))


def retrieval_quality(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """n, mrr, recall3: how high the sentence that a pseudo-query came from ranks."""
    own = hits.where("id = seq").select("id", "rank")
    ranks = queries.select("id").join(own, "id", "left")
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce((F.col("rank") <= 3).cast("double"), F.lit(0.0))), 6).alias("recall3"))


def clamped(deltas: DataFrame, key: str, order: str, delta: str, low: float, high: float) -> DataFrame:
    """key and score: a running score that never leaves [low, high], folded over each key's events in order."""
    same, step, put = folds.clamps()
    moved = folds.folded(deltas.withColumn(delta, F.col(delta).cast("double")), key, order, [delta], same, lambda f, e: step(f, e[delta], F.lit(low), F.lit(high)), put, F.lit(0.0))
    return moved.select(key, F.round("state", 6).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.when(dot(x, x) > 0, F.sqrt(dot(x, x))).otherwise(1.0)
    return dot(a, b) / (norm(a) * norm(b))
