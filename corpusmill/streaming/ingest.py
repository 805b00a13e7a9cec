"""Continuous ingestion: a drop folder, batches merged into tables, first-wins over time, decayed session state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from corpusmill.functions import text as T
from corpusmill.operators import corpus


def inbox(spark: SparkSession, path: str, archive: str | None = None, most_files: int = 100) -> DataFrame:
    """New text files of a folder as a stream of (source, text); read files move to ``archive``."""
    stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", True)
    if archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return stream.load(path).select(F.concat(F.lit("inbox:"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("source"), F.col("value").alias("text"))


def learn(stream: DataFrame, table: str, checkpoint: str, admission: float = 0.0, once: bool = True) -> StreamingQuery:
    """Adds each micro-batch's admitted sentences to a Parquet table, less those it has.

    A batch that is run again after a failure overwrites its own folder, so nothing is learned twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = corpus.sentences(batch.withColumn("doc_id", F.xxhash64("source", "text").bitwiseAND(F.lit((1 << 40) - 1))))
        fresh = corpus.admit(corpus.numbered(rows), admission).where("status = 'kept'").select("source", "text", "quality", F.sha2(F.lower(T.strip("text")), 256).alias("key"))
        earlier = [p for p in range(number) if _exists(spark, f"{table}/batch={p}")]
        if earlier:
            known = spark.read.parquet(*[f"{table}/batch={p}" for p in earlier]).select("key")
            fresh = fresh.join(known, "key", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_of_each(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the time that late rows may take."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def decayed_counts(stream: DataFrame, keep: float = 0.5) -> DataFrame:
    """user, n, weight: each batch halves what a user's session weighs before it adds its rows."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, weight = state.get if state.exists else (0, 0.0)
        rows = sum(len(p) for p in parts)
        n, weight = n + rows, weight * keep + rows
        state.update((n, weight))
        yield pd.DataFrame({"user": [key[0]], "n": [n], "weight": [weight]})

    return stream.groupBy("user").applyInPandasWithState(update, "user long, n long, weight double", "n long, weight double", "update", "NoTimeout")


def run_to_end(start: Callable[[], StreamingQuery]) -> None:
    """Runs a query over all that is there now."""
    start().awaitTermination()
