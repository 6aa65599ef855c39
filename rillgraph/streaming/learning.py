"""Learning as it happens: each micro-batch of verdicts becomes one version of the personal layer, the pool and the global layer.

A batch's number is its version's in all three logs. A log that has the number already is left alone, so a batch that is run again,
whether it was lost before, between or after the three commits, changes nothing twice: what each log gets is computed from the versions
before the batch only. A batch reads and writes the keys that it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillgraph.config import CONFIG
from rillgraph.operators.equivalence import canonical
from rillgraph.operators.learning import EDGE, adjust
from rillgraph.session import Scratch
from rillgraph.sources.versions import Versions

USER_EDGE = ["user_label", *EDGE]
#: Rows of a batch: a learning path of a query with its verdict's direction (1, 0, -1); user_label null: nobody's.
VERDICT = "query_id long, user_label string, direction int, source string, target string, relation string"
_POOL = "source string, target string, relation string, count long, contributors array<string>, status string"


class Memory:
    """The three tables in a folder that driver and executors share.

    layer: edge, weight for everybody; personal: user_label, edge, weight; pool: edge, count, contributors, status.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, folder = spark, folder.rstrip("/")
        self.layer, self.personal, self.pool = (Versions(spark, f"{folder}/{name}", key) for name, key in (("layer", EDGE), ("personal", USER_EDGE), ("pool", EDGE)))

    def start(self, edges: DataFrame, personal: DataFrame) -> None:
        """Version 0: edges and personal edges as they are, an empty pool."""
        self.layer.write(edges.select(*EDGE, "weight"), 0)
        self.personal.write(personal.select(*USER_EDGE, "weight"), 0)
        self.pool.write(self.spark.createDataFrame([], _POOL), 0)

    @staticmethod
    def _before(log: Versions, number: int, keys: DataFrame) -> DataFrame:
        """The rows of the listed keys before a batch."""
        return log.read(max(n for n in log.numbers() if n < number)).join(keys, log.key, "left_semi")

    def apply(self, batch: DataFrame, number: int, aliases: DataFrame | None = None) -> None:
        """One batch (VERDICT): paths of a known user change that user's layer and are submitted to the pool, others change the global
        layer; candidates that are seen often enough get a global edge."""
        if all(number in log.numbers() for log in (self.personal, self.pool, self.layer)):
            return
        with Scratch(self.spark) as scratch:
            rows = scratch.put(batch.filter("direction <> 0").withColumn("delta", F.col("direction") * CONFIG.weight_delta), "verdicts")
            own, others = rows.filter("user_label is not null"), rows.filter("user_label is null")
            self.personal.change(adjust(self._before(self.personal, number, own.select(*USER_EDGE).distinct()), own, key=USER_EDGE), number)

            seen = canonical(own.select("user_label", *EDGE), aliases).groupBy(*EDGE).agg(F.count("*").alias("__n"), F.collect_set("user_label").alias("__users"))
            old = self._before(self.pool, number, seen.select(*EDGE))
            count = F.coalesce("count", F.lit(0)) + F.col("__n")
            users = F.array_sort(F.array_union(F.coalesce("contributors", F.array().cast("array<string>")), "__users"))
            up = (count >= CONFIG.pool_threshold) & F.coalesce(F.col("status") != "upgraded", F.lit(True))
            new = seen.join(old, EDGE, "left").select(*EDGE, count.alias("count"), users.alias("contributors"), F.when(up, "upgraded").otherwise(F.coalesce("status", F.lit("pending"))).alias("status"), up.alias("__up"))
            new = scratch.put(new, "pool-change")
            self.pool.change(new.drop("__up"), number)

            raised = new.filter("__up").select(*EDGE)
            keys = others.select(*EDGE).union(raised).distinct()
            edges = adjust(self._before(self.layer, number, keys), others).join(raised.withColumn("__up", F.lit(True)), EDGE, "full_outer")
            weight = F.when(F.col("__up"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(CONFIG.pool_weight))).otherwise(F.col("weight"))
            self.layer.change(edges.select(*EDGE, weight.alias("weight")), number)


def learn_into(stream: DataFrame, memory: Memory, progress: str, every: str | None = None, aliases: DataFrame | None = None) -> StreamingQuery:
    """Start to learn from a stream of VERDICT rows. progress: a folder that driver and executors share.

    every: the time between triggers; without it, what is there is learned and the query ends.
    """
    writer = stream.writeStream.foreachBatch(lambda batch, number: memory.apply(batch, number + 1, aliases)).option("checkpointLocation", progress)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
