"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode (tests), where the session may name none, a temporary folder is set.
    """
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not got:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        got = sc.getCheckpointDir()
    return got.rstrip("/")


def clean_up(spark: SparkSession) -> None:
    """Deletes what this application's operators wrote to the shared folder; frames made of it are then void."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, which cuts its lineage.

    The files live in a folder of this application and survive the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", broadcast_rows: int = 2_000_000) -> DataFrame:
    """``docs`` less the ids in ``dropped`` (column doc_id), with all columns of ``docs``.

    The ids are counted; up to ``broadcast_rows`` of them (16 MB) are broadcast, so texts need no shuffle, and more are
    sort-merge joined.
    """
    name = fresh(docs, "__gone")
    gone = materialize(dropped.select(F.col("doc_id").alias(name)).distinct(), "dropped")
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone.hint("merge")
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")


def by_row(docs: DataFrame, found: DataFrame, decide: Callable[[DataFrame, str], DataFrame], id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, with all columns of ``docs``.

    ``found`` has doc_id and kept for each row. Rows whose doc_id does not repeat are decided by it. The others are
    numbered, and ``decide`` tells of them (given the name of that number's column) the numbers of the rows that stay.
    """
    ids = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept")).where("n > 1 or not kept"), "verdicts")
    alone = without(docs, ids.select("doc_id"), id_col)
    name, row = fresh(docs, "__again"), fresh(docs, "__row")
    again = ids.where("n > 1").select(F.col("doc_id").alias(name))
    if again.isEmpty():
        return alone
    many = docs.join(again.hint("merge"), F.col(f"`{id_col}`") == F.col(name), "left_semi")
    many = materialize(many.withColumn(row, F.monotonically_increasing_id()), "repeated-ids")
    return alone.unionByName(many.join(decide(many, row).hint("merge"), row, "left_semi").drop(row))


def one_each(docs: DataFrame, found: DataFrame, grouped: Callable[[DataFrame, str], DataFrame], id_col: str = "doc_id") -> DataFrame:
    """The rows that stay of each group, one physical row a group, with all columns of ``docs``.

    ``found`` is as for :func:`by_row`; ``grouped`` gives the row's number, group, kept and worse (any order of the kept rows).
    """

    def decide(many: DataFrame, row: str) -> DataFrame:
        best = grouped(many, row).where("kept").groupBy("group").agg(F.min(F.struct("worse", row)).alias("best"))
        return best.select(F.col(f"best.{row}").alias(row))

    return by_row(docs, found, decide, id_col)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for each row and hands it to ``body``.

    A plain alias can be inlined into a lambda by the optimiser, where it would be computed for every element.
    """
    return F.transform(F.array(value), body).getItem(0)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each has at most about ``max_bytes`` of text (or one row)."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
