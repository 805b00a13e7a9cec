"""Word n-gram counts, interpolated absolute discounting, pruning, longest-match continuations and sub-word units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed as K
from corpusmill.functions import text as T
from corpusmill.operators.store import stored

START, STOP = "<s>", "</s>"
#: Ids of unknown, start and end.
SPECIALS = 3


def sequence_of(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(START)), tokens, F.array(F.lit(STOP)))


def events(rows: DataFrame, orders: int = 3, keep: list[str] | None = None) -> DataFrame:
    """n, ctx, tok: each token after each context of 0 to orders-1 tokens; an order needs one token more than its context has."""

    def of(ids: Column) -> Column:
        out = []
        for n in range(orders):
            some = F.size(ids) - 1 >= (n + 1 if n else 1)
            made = F.transform(F.sequence(F.lit(max(n, 1)), F.size(ids) - 1), _at(ids, n))
            out.append(F.when(some, made).otherwise(F.array().cast("array<struct<n:int,ctx:string,tok:string>>")))
        return F.concat(*out)

    ids = sequence_of(T.all_matches(F.lower("text"), K.WORD))
    keep = keep or []
    return rows.select(*keep, F.explode_outer(T.let(ids, of)).alias("e")).where("e is not null").select(*keep, "e.n", "e.ctx", "e.tok")


def _event(ids: Column, i: Column, n: int) -> Column:
    context = F.array_join(F.slice(ids, i - n + 1, n), " ") if n else F.lit("")
    return F.struct(F.lit(n).alias("n"), context.alias("ctx"), F.element_at(ids, i + 1).alias("tok"))


def _at(ids: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: _event(ids, i, n)


def corpus_counts(rows: DataFrame, orders: int = 3) -> DataFrame:
    """n, ctx, tok, c of all ``rows``, as :func:`counts` of their events.

    Only the highest order's events are exchanged: dropping the first token of their contexts gives all events of the
    next order but a text's first one, which is made directly. So each lower order is added up from counts.
    """

    def of(ids: Column) -> Column:
        out = []
        for n in range(orders):
            some = F.size(ids) - 1 >= (n + 1 if n else 1)
            longer = F.size(ids) - 1 >= n + 2 if n + 1 < orders else F.lit(False)
            last = F.when(longer, n).otherwise(F.size(ids) - 1)  # of an order that a longer one gives, the first event only
            made = F.transform(F.sequence(F.lit(max(n, 1)), F.greatest(last, F.lit(max(n, 1)))), _at(ids, n))
            out.append(F.when(some if n else some & ~longer, made).otherwise(F.array().cast("array<struct<n:int,ctx:string,tok:string>>")))
        return F.concat(*out)

    ids = sequence_of(T.all_matches(F.lower("text"), K.WORD))
    made = counts(rows.select(F.explode_outer(T.let(ids, of)).alias("e")).where("e is not null").select("e.n", "e.ctx", "e.tok"))
    made = stored(made, "ngram-events")
    whole, above = None, None
    for n in reversed(range(orders)):
        own = made.where(F.col("n") == n)
        if above is not None:
            context = F.substring_index("ctx", " ", -n) if n else F.lit("")
            own = own.unionByName(above.select(F.lit(n).alias("n"), context.alias("ctx"), "tok", "c")).groupBy("n", "ctx", "tok").agg(F.sum("c").alias("c"))
        above = own
        whole = own if whole is None else whole.unionByName(own)
    return whole


def counts(made: DataFrame) -> DataFrame:
    return made.groupBy("n", "ctx", "tok").agg(F.count(F.lit(1)).alias("c"))


def continuations(counted: DataFrame) -> DataFrame:
    """tok, cont: how many distinct tokens it follows."""
    return counted.where("n = 1").groupBy("tok").agg(F.count(F.lit(1)).alias("cont"))


def contexts(counted: DataFrame) -> DataFrame:
    return counted.groupBy("n", "ctx").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"))


def prune(counted: DataFrame, least: int = 2, orders: int | None = None) -> DataFrame:
    """Without rare entries of higher orders (totals are those of what is left)."""
    kept = counted.where((F.col("n") == 0) | (F.col("c") >= least))
    return kept if orders is None else kept.where(F.col("n") < orders)


def probabilities(asked: DataFrame, counted: DataFrame, orders: int = 3, discount: float = K.DISCOUNT) -> DataFrame:
    """Adds p to rows (ids, i): the probability of token i after the tokens before it.

    A base of continuation counts, then one pair of left joins for each order; unseen contexts are passed over.
    """
    counted = stored(counted, "ngrams")
    cont = continuations(counted)
    sums = cont.agg(F.coalesce(F.sum("cont"), F.lit(0)).alias("cont_total")).join(counted.where("n = 0").agg((F.count(F.lit(1)) + SPECIALS).alias("v")), F.lit(True))
    out = asked.withColumn("tok", F.element_at("ids", F.col("i") + 1)).join(cont, "tok", "left").join(F.broadcast(sums), F.lit(True))
    out = out.withColumn("p", (F.coalesce("cont", F.lit(0)) + 1.0) / (F.col("cont_total") + F.col("v"))).drop("cont", "cont_total", "v")
    heads = contexts(counted)
    for n in range(1, orders):
        context = F.when(F.col("i") >= n, F.array_join(F.slice("ids", F.col("i") - n + 1, n), " "))
        out = out.withColumn("ctx", context)
        out = out.join(heads.where(F.col("n") == n).select("ctx", "total", "types"), "ctx", "left")
        out = out.join(counted.where(F.col("n") == n).select("ctx", "tok", "c"), ["ctx", "tok"], "left")
        better = F.greatest(F.coalesce("c", F.lit(0)) - discount, F.lit(0.0)) / F.col("total") + discount * F.col("types") / F.col("total") * F.col("p")
        out = out.withColumn("p", F.when(F.col("total").isNotNull(), better).otherwise(F.col("p"))).drop("ctx", "total", "types", "c")
    return out


def asked(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row (ids, i) for each token, the end included."""
    out = rows.select(*keep, sequence_of(T.all_matches(F.lower("text"), K.WORD)).alias("ids"))
    return out.select(*keep, "ids", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("i"))


def perplexity(p: Column) -> Column:
    return F.exp(-F.avg(F.log(F.greatest(p, F.lit(1e-12)))))


def longest_continuations(histories: DataFrame, rows: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """id, length, next, n: what follows the longest end of each history that the corpus has.

    Corpus positions are found by the history's last two tokens, then matches are lengthened in place.
    """
    tokens = T.all_matches(F.lower("text"), K.WORD)
    pair = lambda a, i: F.concat_ws(" ", F.element_at(a, i - 1), F.element_at(a, i))
    asked_ = histories.select("id", tokens.alias("h")).where(F.size("h") >= least).withColumn("pair", pair(F.col("h"), F.size("h")))
    # a text's end is a token too
    bodies = rows.select(F.concat(tokens, F.array(F.lit(STOP))).alias("t")).where(F.size("t") > least)
    found = bodies.select("t", F.explode(F.sequence(F.lit(2), F.size("t") - 1)).alias("i")).withColumn("pair", pair(F.col("t"), F.col("i")))
    hits = found.join(asked_, "pair")
    same = F.aggregate(
        F.sequence(F.lit(0), F.least(F.lit(most), F.col("i"), F.size("h")) - 1),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, k: F.struct((a["n"] + F.when(a["on"] & (F.element_at("t", F.col("i") - k) == F.element_at("h", F.size("h") - k)), 1).otherwise(0)).alias("n"), (a["on"] & (F.element_at("t", F.col("i") - k) == F.element_at("h", F.size("h") - k))).alias("on")),
        lambda a: a["n"],
    )
    hits = hits.select("id", same.alias("length"), F.element_at("t", F.col("i") + 1).alias("next"))
    best = hits.groupBy("id").agg(F.max("length").alias("length"))
    return hits.join(best, ["id", "length"]).groupBy("id", "length", "next").agg(F.count(F.lit(1)).alias("n")).withColumn("length", F.col("length").cast("long"))


def subword_counts(rows: DataFrame) -> DataFrame:
    """gram, n: pieces of 2 to 4 characters within runs of one script."""
    runs = T.all_matches(F.lower("text"), rf"[a-z0-9]+|[{K.KANJI}]+|[{K.KANA}]+")

    def pieces(run: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.lit(4), F.length(run))), lambda k: F.transform(F.sequence(F.lit(1), F.length(run) - k + 1), lambda i: F.substr(run, i, k))))

    return rows.select(F.explode_outer(F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= 2), pieces))).alias("gram")).where("gram is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def subword_vocabulary(rows: DataFrame, size: int = 500, least: int = 2) -> DataFrame:
    """gram, score: the pieces that save most characters; ties by the later piece."""
    some = subword_counts(rows).where(F.col("n") >= least).withColumn("score", F.col("n") * (F.length("gram") - 1))
    return some.orderBy(F.desc("score"), F.desc("gram")).limit(size).select("gram", F.col("score").cast("long").alias("score"))


def cooccurrence(rows: DataFrame, window: int = K.WINDOW) -> DataFrame:
    """term, neighbour, weight: neighbours within ``window`` phrases count 1, direct ones 2."""
    found = rows.select(T.phrases("text").alias("p")).where(F.size("p") >= 2)

    def around(p: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(p))
        return F.flatten(F.transform(places, lambda i: F.transform(F.filter(F.sequence(F.greatest(i - window, F.lit(1)), F.least(i + window, F.size(p))), lambda j: j != i), lambda j: F.struct(F.element_at(p, i).alias("term"), F.element_at(p, j).alias("neighbour"), F.when(F.abs(i - j) == 1, 2).otherwise(1).alias("w")))))

    return found.select(F.inline_outer(around(F.col("p")))).where("term is not null").groupBy("term", "neighbour").agg(F.sum("w").alias("weight"))


def backoff(counted: DataFrame, orders: int) -> DataFrame:
    """ctx, tok, p of the highest order: relative frequency."""
    heads = contexts(counted).where(F.col("n") == orders - 1)
    return counted.where(F.col("n") == orders - 1).join(heads, ["n", "ctx"]).select("ctx", "tok", F.round(F.col("c") / F.col("total"), 6).alias("p"))


def top_next(counted: DataFrame, n: int, k: int) -> DataFrame:
    """The ``k`` most frequent tokens after each context."""
    w = Window.partitionBy("ctx").orderBy(F.desc("c"), "tok")
    return counted.where(F.col("n") == n).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("ctx", "tok", "c", "rank")
