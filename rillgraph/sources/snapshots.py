"""Versioned snapshots of a table, stop words, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY = "word string, definition string, definitions array<string>, pinyin string, domain string"


def write_snapshot(df: DataFrame, folder: str, version: int) -> str:
    """Write a version once: versions are growing numbers and never replaced, so a reader never sees half a state."""
    path = f"{folder.rstrip('/')}/version={version:012d}"
    df.write.mode("error").parquet(path)
    return path


def read_snapshot(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/version={version:012d}")


def stopwords(spark: SparkSession, path: str, builtin: list[str]) -> DataFrame:
    """word: the builtin ones and the lines of a file, blank lines and # comments left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> '' and not word like '#%'")
    return lines.union(spark.createDataFrame([(w,) for w in builtin], "word string")).distinct()


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary entries from JSON lines; entries that do not parse are left out."""
    return spark.read.schema(DICTIONARY).option("mode", "DROPMALFORMED").json(path).filter("word is not null")


def latest_embeddings(df: DataFrame, size: int = 384) -> DataFrame:
    """id, embedding: the last `size` components."""
    return df.select("id", F.expr(f"slice(embedding, greatest(1, size(embedding) - {size} + 1), {size})").alias("embedding"))
