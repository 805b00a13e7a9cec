"""Exact de-duplication against a persistent digest index.

The index is a table bucketed and sorted by digest, to which is only appended. A batch of documents is reduced to one row
for each digest (with map-side aggregation, so a group that holds a third of all rows costs one row a task) and compared
with the index by a sort-merge anti-join that reads the index buckets in order. What the index lacks is appended: new
digests, and better rows of known ones (more code points, then the smaller doc_id). So a text's keeper is its best
entry, whatever the order in which batches came.

Defined results: null text counts as empty; empty texts are equal to one another; repeated rows count each, and of rows
that repeat both doc_id and text one stays; an empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, one_each

BLANKS = "\t\n\x0b\x0c\r "


def normalised(text: Column) -> Column:
    """Deletes every character of [\\x20\\x09-\\x0D]; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (32 bytes of SHA-256 over the normalised text) and the code points of the original text."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_code_points"),
    )


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest: the best row's less (code points, negated), keep_id and row, and group_size."""
    best = F.min(F.struct((-F.col("n_code_points")).alias("less"), F.col("doc_id").alias("keep_id"), F.col("row"))).alias("best")
    return rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")).select("digest", "best.less", "best.keep_id", "best.row", "group_size")


class DigestIndex:
    """The persistent index: ``digest``, ``less`` (code points, negated), ``keep_id``, its ``row`` and the ``batch`` that added it."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int = 32):
        self.spark, self.table, self.buckets = spark, table or f"digest_index_{uuid.uuid4().hex}", buckets
        if not spark.catalog.tableExists(self.table):
            self._append(spark.createDataFrame([], "digest binary, less long, keep_id long, row long, batch string"))

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def keepers(self) -> DataFrame:
        """digest, keep_id, row and batch of each text's best entry; read in buckets, so without a shuffle."""
        best = self.read().groupBy("digest").agg(F.min(F.struct("less", "keep_id", "row", "batch")).alias("best"))
        return best.select("digest", "best.keep_id", "best.row", "best.batch")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def lacking(self, groups: DataFrame) -> DataFrame:
        """The groups (see :func:`grouped`) for which the index has no entry as good: a sort-merge anti-join."""
        held = self.read().select(F.col("digest").alias("held"), F.struct("less", "keep_id").alias("as_good"))
        return groups.join(held.hint("merge"), (F.col("digest") == F.col("held")) & (F.col("as_good") <= F.struct("less", "keep_id")), "left_anti")

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Appends what the index lacks of a batch of rows (:func:`digests` with a ``row`` number); returns its groups."""
        groups = materialize(grouped(rows), "digest-groups")
        new = self.lacking(groups).select("digest", "less", "keep_id", "row", F.lit(batch).alias("batch"))
        self._append(new.repartition(self.buckets, "digest"))
        return groups


#: Digests in a bucket of an index made for one call.
BUCKET_ROWS = 4_000_000


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size (in these documents), kept, text_sha256.

    The documents go through the index in ``batches``, each against what the ones before it left. With an index of
    earlier documents, a text seen before keeps the earlier row and none of these, unless one of these is better;
    without one, an index is made for the call and dropped at its end.
    """
    rows = digests(docs, id_col, text_col).withColumns({"row": F.monotonically_increasing_id(), "batch": F.pmod(F.xxhash64("digest", "doc_id"), F.lit(batches))})
    rows = materialize(rows, "digests")
    own = index or DigestIndex(docs.sparkSession, buckets=max(32, -(-rows.count() // BUCKET_ROWS)))
    run, groups = uuid.uuid4().hex, None
    for i in range(batches):
        part = own.add(rows.where(F.col("batch") == i), f"{run}-{i}").select("digest", "group_size")
        groups = part if groups is None else groups.unionByName(part)
    sizes = groups.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    best = own.keepers().select("digest", "keep_id", F.col("row").alias("keep_row"), F.col("batch").alias("keep_batch"))
    # one row for each group, written once more: both sides of the last join are then shuffled, and Spark can split a hot group
    keepers = materialize(sizes.join(best.hint("merge"), "digest"), "digest-keepers")
    if index is None:
        own.drop()
    kept = (F.col("row") == F.col("keep_row")) & (F.concat(F.lit(f"{run}-"), F.col("batch").cast("string")) == F.col("keep_batch"))
    return rows.join(keepers.hint("merge"), "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one row for each digest, with all their columns; rows may repeat a doc_id."""
    found = materialize(exact_dedup(docs, id_col=id_col, text_col=text_col), "exact-dedup")
    keepers = found.select(F.col("text_sha256").alias("group"), F.col("keep_id").alias("__keep")).distinct()

    def rows_of(many: DataFrame, row: str) -> DataFrame:
        text = F.col(text_col)
        own = many.select(row, F.col(id_col).alias("doc_id"), F.sha2(normalised(text).cast("binary"), 256).alias("group"), (-F.length(F.coalesce(text, F.lit("")))).alias("worse"))
        return own.join(keepers.hint("merge"), "group").withColumn("kept", F.col("doc_id") == F.col("__keep"))

    return one_each(docs, found, rows_of, id_col)
