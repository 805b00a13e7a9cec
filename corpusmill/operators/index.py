"""Inverted index and counts: postings, document frequencies, related terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.store import stored

TF_MOST = 255


def postings(rows: DataFrame, key: str = "seq") -> DataFrame:
    """key, term, tf for every term of each text; counted map-side before the shuffle."""
    counted = rows.select(key, F.explode_outer(T.terms("text")).alias("term")).where("term is not null").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return counted.withColumn("tf", F.least("tf", F.lit(TF_MOST)).cast("long"))


def lengths(rows: DataFrame, key: str = "seq") -> DataFrame:
    """key and dl, the number of terms of each text that has any."""
    return rows.select(key, F.size(T.terms("text")).cast("long").alias("dl")).where("dl > 0")


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def related_terms(posted: DataFrame, wanted: DataFrame, k: int = 3, newest: int = 40, candidates: int = 60, key: str = "seq") -> DataFrame:
    """term, related, score, rank: phrases that share sentences with each wanted term more often than chance has it.

    Of each wanted term only the ``newest`` sentences count, so their terms are few whatever the corpus holds.
    """
    posted = stored(posted, "postings")
    n = posted.select(F.countDistinct(key).alias("n"))
    df = document_frequency(posted)
    newest_of = Window.partitionBy("term").orderBy(F.desc(key))
    seeds = posted.join(wanted.select("term").distinct(), "term", "left_semi").withColumn("k", F.row_number().over(newest_of)).where(F.col("k") <= newest).select(key, F.col("term").alias("seed"))
    near = posted.where(T.is_phrase(F.col("term"))).select(key, F.col("term").alias("u")).join(seeds, key)
    near = near.where((F.instr("u", F.col("seed")) == 0) & (F.instr("seed", F.col("u")) == 0))
    together = near.groupBy("seed", "u").agg(F.count(F.lit(1)).alias("c"))
    top = together.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("c"), "u"))).where(F.col("r") <= candidates)
    longer = top.select("seed", F.col("u").alias("v"))
    inside = top.join(longer, "seed").where((F.length("v") > F.length("u")) & (F.instr("v", F.col("u")) > 0)).select("seed", "u").distinct()
    kept = top.join(inside, ["seed", "u"], "left_anti").where("c >= 2")
    scored = kept.join(df.withColumnRenamed("term", "u").withColumnRenamed("df", "df_u"), "u").where("df_u >= 2").join(df.withColumnRenamed("term", "seed").withColumnRenamed("df", "df_t"), "seed").join(F.broadcast(n), F.lit(True))
    pmi = F.log(F.col("c") * F.col("n") / (F.col("df_t") * F.col("df_u")) + 1e-9)
    scored = scored.withColumn("pmi", pmi).where("pmi > 0.5").withColumn("score", F.round(F.col("pmi") * F.least(F.lit(1.0), F.col("c") / 5), 6))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "u")))
    return ranked.where(F.col("rank") <= k).select(F.col("seed").alias("term"), F.col("u").alias("related"), "score", F.col("rank").cast("long").alias("rank"))


def merge_postings(old: DataFrame, new: DataFrame, removed: DataFrame, key: str = "seq") -> DataFrame:
    """Postings after some rows were added (the later count stands) and some removed."""
    both = old.withColumn("v", F.lit(0)).unionByName(new.withColumn("v", F.lit(1)))
    last = both.groupBy("term", key).agg(F.max(F.struct("v", "tf")).alias("x"))
    return last.join(removed.select(key).distinct(), key, "left_anti").select(key, "term", F.least(F.col("x.tf"), F.lit(TF_MOST)).alias("tf"))


def coverage(weights: Column, hit: Column) -> Column:
    """The share of a query's term weight that a text has."""
    return F.sum(F.when(hit, weights).otherwise(0.0)) / F.sum(weights)
