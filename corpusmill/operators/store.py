"""Tables written in the folder that driver and executors share, where several branches of a plan read the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, label: str = "table", compression: str = "snappy") -> DataFrame:
    """Writes ``df`` once and reads it back: its work is not done again for each branch, and lost executors cost nothing."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        folder = sc.getCheckpointDir()
    path = f"{folder.rstrip('/')}/{sc.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
