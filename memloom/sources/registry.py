"""Sources by name: what a path is read with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ["id", "source", "content", "doc_length"]


@dataclass(frozen=True)
class Source:
    """How records (id, source, content, doc_length) are read from a path that the source supports."""

    name: str
    supports: Callable[[str], bool]
    read: Callable[[SparkSession, str], DataFrame]


_SOURCES: dict[str, Source] = {}


def register(source: Source) -> Source:
    """Make a source known; a later one of the same name replaces it."""
    _SOURCES[source.name] = source
    return source


def names() -> list[str]:
    return [*_SOURCES]


def source_of(path: str, name: str | None = None) -> Source:
    """The named source, else the first registered one that supports the path."""
    for s in _SOURCES.values():
        if s.name == name or (name is None and s.supports(path)):
            return s
    raise LookupError(f"no source for {name or path}")


def ingest(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The records of a path."""
    own = source_of(path, name)
    return own.read(spark, path).withColumn("source", F.lit(own.name)).select(*RECORD)


def _records(df: DataFrame, key: str, content: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("id"), F.col(content).cast("string").alias("content"), F.octet_length(F.col(content).cast("string")).alias("doc_length"))


def _files(pattern: str) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, path: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
        return _records(files.select("path", F.decode("content", "UTF-8").alias("content")), "path", "content")

    return read


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select("value", F.xxhash64("value").alias("id"))
    return _records(rows, "id", "value")


register(Source("json_lines", lambda p: p.endswith((".jsonl", ".ndjson")), _lines))
register(Source("markdown", lambda p: "." not in p.rstrip("/").rpartition("/")[2] or p.endswith(".md"), _files("*.md")))
