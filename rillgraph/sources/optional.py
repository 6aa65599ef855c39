"""Files that may be absent or broken: what depends on them is skipped, and the outcome is told."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.session import written

CORRUPT = "__corrupt"


@dataclass(frozen=True)
class Source:
    """rows: what could be read, None if nothing; outcome: absent, corrupt or good; lost: lines that were left out."""

    rows: DataFrame | None
    outcome: str
    lost: int = 0


def json_lines(spark: SparkSession, path: str | None, schema: str, required: str) -> Source:
    """JSON lines of a file or folder. No path, or nothing there: absent. Lines that are no JSON of the schema or lack the required column are
    lost; a file all of whose lines are is corrupt. An empty file is good. The lines are read once; two counts reach the driver."""
    if path is None:
        return Source(None, "absent")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return Source(None, "absent")
    read = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    rows = written(read, "optional")
    good = F.isnull(CORRUPT) & F.col(required).isNotNull()
    n = rows.agg(F.count_if(good).alias("good"), F.count_if(~good).alias("lost")).first()
    if n.lost and not n.good:
        return Source(None, "corrupt", n.lost)
    return Source(rows.filter(good).drop(CORRUPT), "good", n.lost)
