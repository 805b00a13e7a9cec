"""The registry of the engine's queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "bm25_search"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
MODULES = ("text_queries", "corpus_queries", "retrieval_queries", "fact_queries", "dialog_queries", "adaptive_queries", "model_queries", "judging_queries", "training_queries", "control_queries")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under its name, with DuckDB SQL for the same rows if there is any."""

    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"corpusmill.plans.{module}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt out, as a file with one row group is one task."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages", "conversations") and len(df.inputFiles()) < cores else df
