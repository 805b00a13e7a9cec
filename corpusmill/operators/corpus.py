"""The corpus as tables: sentences, admission with first-wins de-duplication, holdouts, spans and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.store import stored

#: Sentence numbers leave room for so many sentences in a document.
PER_DOCUMENT = 1_000_000
#: Rows of a block in a distributed running sum.
BLOCK = 4096


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, source, text: the sentences of each document, in order; no shuffle."""
    # not a plain explode: the optimiser would compute the sentences once more, to drop documents without any
    found = docs.select("doc_id", "source", F.posexplode_outer(T.split_sentences("text")).alias("pos", "text")).where("pos is not null")
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "source", "text")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``seq``, the order in which sentences arrive; a document of more sentences than have room is an error."""
    fits = F.when(F.col("pos") < PER_DOCUMENT, F.col("pos")).otherwise(F.raise_error(F.lit(f"a document has more than {PER_DOCUMENT} sentences")).cast("long"))
    return rows.withColumn("seq", F.col("doc_id") * PER_DOCUMENT + fits)


def first_wins(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Adds ``first``, the least ``order`` among rows of the same key (null: none), and ``copies``.

    One row for each key is shuffled after map-side aggregation, and the join that follows may be split by key, so a
    group of any size never meets in one task as it would in a window.
    """
    firsts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    return rows.join(firsts, key, "left")


def running_sum(rows: DataFrame, block: Column, order: list[Column | str], value: Column, out: str, level: int = 0) -> DataFrame:
    """Adds the sum of ``value`` up to each row, in order of ``block`` and then ``order``.

    The sum runs within blocks and over the sums of blocks; those are summed likewise, in blocks of ``BLOCK``, so that the
    one task at the top has a row for each ``BLOCK`` blocks.
    """
    name, own, before = f"_block{level}", f"_value{level}", f"_before{level}"
    rows = rows.withColumn(name, block).withColumn(own, value)
    sums = rows.groupBy(name).agg(F.sum(own).alias("_sum"))
    if level:
        earlier = F.sum("_sum").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.select(name, F.coalesce(earlier, F.lit(0)).alias(before))
    else:
        sums = running_sum(sums, F.floor(F.col(name) / BLOCK), [name], F.col("_sum"), "_upto", level + 1).select(name, (F.col("_upto") - F.col("_sum")).alias(before))
    within = rows.withColumn("_within", F.sum(own).over(Window.partitionBy(name).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return within.join(sums, name).withColumn(out, F.col(before) + F.col("_within")).drop(name, own, before, "_within")


def _checked(rows: DataFrame, admission: float) -> DataFrame:
    checked = rows.withColumns({"quality": T.sentence_quality("text"), "content_key": T.content_key("text"), "plain": F.lower(T.strip("text"))})
    passes = (F.col("quality") >= admission) & F.length("text").between(4, 600) & F.col("text").rlike(r"[\p{L}\p{N}]") & ~T.is_junk("text")
    return checked.withColumn("key", F.when(passes, F.sha2(F.coalesce(F.concat(F.lit("k"), "content_key"), F.concat(F.lit("t"), "plain")), 256)))


def first_kept(rows: DataFrame, admission: float, **columns: Column) -> DataFrame:
    """seq, quality and ``columns`` of the sentences that :func:`admit` keeps, for those who don't need the others.

    One exchange by half of each key's digest, with one row for each key and task, and neither texts nor a stored table.
    """
    checked = _checked(rows, admission)
    key, kept = F.unhex(F.substring("key", 1, 32)), F.col("key").isNotNull()
    one = F.struct("seq", "quality", kept.alias("kept"), *[F.when(kept, c).alias(n) for n, c in columns.items()])
    # rejected ones are one group, dropped afterwards: dropped before, their keys would be computed twice
    firsts = checked.select(key.alias("key"), one.alias("x")).groupBy("key").agg(F.min_by("x", "x.seq").alias("x"))
    return firsts.where("x.kept").select("x.seq", "x.quality", *[f"x.{n}" for n in columns])


def admit(rows: DataFrame, admission: float = 0.0) -> DataFrame:
    """Adds quality, ``status`` and ``origin`` (the sentence kept in its place) to numbered sentences.

    Filters come first, as rejected sentences never register a key; then the first sentence with a content key wins,
    and where the key is null the first with the same text.
    """
    checked = _checked(rows, admission)
    # read twice: for the first of each key, and for the rows
    won = first_wins(stored(checked.select(*rows.columns, "quality", "key"), "checked"), "key")
    status = F.when(F.col("key").isNull(), "rejected").when(F.col("first") == F.col("seq"), "kept").otherwise("duplicate")
    return won.select(*rows.columns, "quality", status.alias("status"), F.col("first").alias("origin"))


def corroborated(admitted: DataFrame, step: float = 0.5, most: float = 20.0) -> DataFrame:
    """seq, sources and score of kept sentences: other sources that say the same add ``step`` each time."""
    kept = admitted.where("status = 'kept'").select(F.col("seq").alias("origin"), F.col("source").alias("own"))
    again = admitted.where("status = 'duplicate'").select("origin", "source").join(kept, "origin").where("source != own")
    said = again.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("others"))
    return kept.join(said, "origin", "left").select(
        F.col("origin").alias("seq"), (1 + F.coalesce("others", F.lit(0))).alias("sources"), F.least(F.lit(most), step * F.coalesce("n", F.lit(0))).alias("score")
    )


def holdout(rows: DataFrame, every: int = 40) -> DataFrame:
    """Adds ``held_out``: each ``every``-th sentence in order of arrival."""
    block = F.floor(F.col("doc_id") / 256)
    out = running_sum(rows, block, ["seq"], F.lit(1), "number")
    return out.withColumn("held_out", F.col("number") % every == 0).drop("number")


def spans(rows: DataFrame, least: int = 350, tail: int = 40) -> DataFrame:
    """doc_id, span, text: consecutive sentences of a document, joined until they have ``least`` characters; a short tail goes."""
    lists = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("s"))
    empty = F.struct(T.strings().alias("done"), F.lit("").alias("open"))

    def add(a: Column, x: Column) -> Column:
        grown = F.concat(a["open"], x["text"])
        full = F.length(grown) >= least
        return F.struct(F.when(full, F.concat(a["done"], F.array(grown))).otherwise(a["done"]).alias("done"), F.when(full, "").otherwise(grown).alias("open"))

    packed = F.aggregate("s", empty, add, lambda a: F.when(F.length(a["open"]) >= tail, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    return lists.select("doc_id", F.posexplode(packed).alias("span", "text"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Adds the next sentence of the same document, if it follows directly."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return rows.withColumn("next_text", F.when(F.lead("pos").over(w) == F.col("pos") + 1, F.lead("text").over(w)))


def newest_within(rows: DataFrame, size: Column, budget: int, order: str = "seq", block: Column | None = None) -> DataFrame:
    """The newest rows whose sizes add up to at most ``budget``; a row too large for a quarter of it never counts."""
    fits = rows.where(size <= budget // 4)
    block = -F.floor(F.col(order) / (BLOCK * PER_DOCUMENT)) if block is None else block
    return running_sum(fits, block, [F.desc(order)], size, "used").where(F.col("used") <= budget).drop("used")


def round_robin(rows: DataFrame, group: str, rank: list[Column], limit: int) -> DataFrame:
    """``limit`` rows, taken in turn from each group's best; each task keeps a group's first ``limit`` before the exchange."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*rank))
    return rows.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", group).limit(limit)


def keep_score(score: Column, source: Column, quality: Column, hits: Column, age_days: Column) -> Column:
    """What a sentence is worth when space runs out."""
    own = F.when(source.isin("user", "chat", "seed"), 3.0).otherwise(0.0)
    return score + own + quality + 0.3 * F.least(hits, F.lit(10)) - 0.2 * age_days


def sample(rows: DataFrame, key: str, n: int, seed: str = "seed") -> DataFrame:
    """``n`` rows, uniformly and reproducibly: the least hashes of seed and key."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)
