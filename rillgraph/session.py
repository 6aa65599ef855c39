"""Sessions: settings that every plan here assumes, and the code's way to the Python workers."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (on a cluster: ship it with --py-files)."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, ROOT])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without one gets a folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rillgraph-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/rillgraph/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of an iteration: df as Parquet in the shared folder, read again; it outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of the input for which a shuffle begins with one more partition, and those of a table that is dealt by a key once that one task takes.
ROWS_A_PARTITION = 500_000
ROWS_A_TASK = 250_000


def spread(spark: SparkSession, rows: int) -> None:
    """Let shuffles of this session begin with partitions in proportion to `rows`; adaptive execution joins those that turn out small.

    So what one task holds does not grow with the input. The number is never lowered.
    """
    name, n = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", math.ceil(rows / ROWS_A_PARTITION)
    if n > int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(name, str(n))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of about so many rows dealt by keys, to as many tasks as its rows ask for where those are more than run at once.

    Rows whose groups are nearly as many as they are dealt before they are grouped: a task that reads files would hold the groups of a whole split.
    """
    n = math.ceil(rows / ROWS_A_TASK)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables of one computation, which are deleted together at its end: with Scratch(spark) as scratch: scratch.put(df, name)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, *self.paths)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own, with AQE on (Spark's default)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rillgraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return share_code(spark)
