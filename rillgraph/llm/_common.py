"""What the operators of this subpackage share: session settings, the shared folder, written tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.session import fresh_path, share_code

#: Rows and bytes in one Arrow batch; documents may be long, so batches hold few of them.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the session's Arrow batches: whole texts are long, 10,000 of them may not fit a worker."""
    share_code(spark)
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def aside(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with all but the needed columns under names that no operator makes, and the way back to docs' columns and any made ones that are named."""
    names = {n: n if n in needed else f"__column{i}" for i, n in enumerate(docs.columns)}
    return docs.toDF(*names.values()), lambda df, *made: df.select(*(F.col(own).alias(n) for n, own in names.items()), *made)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor, and Spark knows their size, so a later join
    broadcasts the table only while it is below autoBroadcastJoinThreshold.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str | None) -> None:
    """Delete a written table that nothing reads any more."""
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
