"""Readers of files, archives and dumps, writers of tables, and the connector interface."""

from __future__ import annotations

import bz2
import io
import lzma
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill.functions import text as T
from corpusmill.sources.markup import decoded, gunzip_start, plain_text, wikitext

TEXT_NAMES = (".txt", ".md", ".html", ".htm", ".csv", ".json", ".xml")
MEMBER_BYTES = 8 << 20


def text_files(spark: SparkSession, path: str, names: str = "*.{txt,md}") -> DataFrame:
    """source and text, line by line, of all files below a folder."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(path)
    return lines.select(F.concat(F.lit("file:"), F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("source"), F.col("value").alias("text"))


def members(name: str, data: bytes) -> Iterator[tuple[str, str]]:
    """(name, text) of an archive's text members, a compressed file, or a plain one."""
    suffix = PurePosixPath(name).suffix.lower()
    if suffix == ".zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if not m.is_dir() and m.filename.lower().endswith(TEXT_NAMES) and m.file_size <= MEMBER_BYTES:
                    text = decoded(z.read(m))
                    yield f"{name}/{m.filename}", plain_text(text) if m.filename.lower().endswith((".html", ".htm")) else text
        return
    unpack = {".gz": gunzip_start, ".bz2": bz2.decompress, ".xz": lzma.decompress}.get(suffix, lambda x: x)
    yield name, decoded(unpack(data))


def archives(spark: SparkSession, path: str, names: str = "*.{zip,gz,bz2,xz,txt}") -> DataFrame:
    """source and text of archive members."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [x for p, c in zip(part["path"], part["content"], strict=True) for x in members(PurePosixPath(p).name, bytes(c))]
            yield pd.DataFrame(found, columns=["source", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    return files.select("path", "content").mapInPandas(run, "source string, text string")


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """source and text of a MediaWiki dump's articles, without redirects and stubs."""
    schema = "title string, ns int, revision struct<text:string>"
    page = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    page = page.where((F.coalesce("ns", F.lit(0)) == 0) & (F.length("revision.text") >= 60) & ~T.is_redirect("revision.text"))
    plain = page.select(F.concat(F.lit("dump:"), F.substring("title", 1, 60)).alias("source"), wikitext("revision.text").alias("text"))
    return plain.where(F.length("text") >= 40)


def list_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """line: the distinct lines of list files, without blanks and comments, in order."""
    out = None
    for i, path in enumerate(paths):
        part = spark.read.text(path).select(F.lit(i).alias("file"), F.monotonically_increasing_id().alias("at"), T.strip("value").alias("line"))
        out = part if out is None else out.unionByName(part)
    some = out.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return some.groupBy("line").agg(F.min(F.struct("file", "at")).alias("k")).orderBy("k").select("line")


def accepted_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """user and bot from questions joined with the answers that were accepted."""
    a = answers.select("answer_id", F.col("body").alias("answer"))
    rows = questions.join(a, F.col("accepted_answer_id") == F.col("answer_id"))
    return rows.select(F.substring(T.strip("title"), 1, 300).alias("user"), F.substring(T.strip("answer"), 1, 600).alias("bot"))


def book_body(c) -> F.Column:
    """A Project Gutenberg text between its start and end marks."""
    return F.substring(F.regexp_extract(c, r"(?s)\*\*\* ?START OF [^\n]*\*\*\*(.*?)\*\*\* ?END OF", 1), 1, 80_000)


def save(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """Writes each table under a folder of its own; a schema version goes with every row's folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/version={version}/{name}")


def load(spark: SparkSession, path: str, names: list[str], version: int = 1) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/version={version}/{name}") for name in names}


def without_removed(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return rows.join(removed.select(key).distinct(), key, "left_anti")


class LinesSource(DataSource):
    """A connector as a Python data source: a named list of texts, dealt over partitions. Others subclass it with a reader of their own."""

    @classmethod
    def name(cls) -> str:
        return "corpusmill_lines"

    def schema(self) -> str:
        return "source string, text string"

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(self.options.get("source", "lines"), self.options.get("text", "").split("\n"))


class LinesReader(DataSourceReader):
    def __init__(self, source: str, lines: list[str]):
        self.source, self.lines = source, lines

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(min(4, len(self.lines)))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        for line in self.lines[partition.value :: 4]:
            yield self.source, line


def ranked_union(*tables: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows of the first source that has them, ``limit`` in all, earlier sources first."""
    out = None
    for i, t in enumerate(tables):
        part = t.withColumn("rank", F.lit(i))
        out = part if out is None else out.unionByName(part)
    best = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    return out.withColumn("k", best).where("k = 1").drop("k").orderBy("rank", key).limit(limit)
