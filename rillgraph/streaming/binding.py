"""Structured Streaming: event ingestion, windowed co-activation, rolling rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The event stream of a folder that gains Parquet files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def co_activations(percepts: DataFrame, concepts: DataFrame, window_ms: int = 1000, late: str = "10 seconds") -> DataFrame:
    """Stream-stream join of percepts and concepts (event_id, seed, ts) at most window_ms apart, within the watermark; no pair across batches is lost.

    The join is on the time bucket, so state is dealt out by time, and old state goes by the watermark.
    """
    bucket = lambda c: F.floor(F.unix_millis(F.col(c)) / window_ms)
    p = percepts.withWatermark("ts", late).select(F.col("event_id").alias("percept_id"), F.col("seed").alias("percept"), F.col("ts").alias("t1"))
    p = p.withColumn("b", F.explode(F.array(*(bucket("t1") + d for d in (-1, 0, 1)))))
    c = concepts.withWatermark("ts", late).select(F.col("event_id").alias("concept_id"), F.col("seed").alias("concept"), F.col("ts").alias("t2")).withColumn("b2", bucket("t2"))
    span = F.expr(f"INTERVAL {window_ms / 1000} SECONDS")
    near = (F.col("b") == F.col("b2")) & (F.col("t2") >= F.col("t1") - span) & (F.col("t2") <= F.col("t1") + span)
    return p.join(c, near).select("percept_id", "concept_id", "percept", "concept")


def joined_in_portions(spark: SparkSession, portions: list[DataFrame], folder: str, window_ms: int = 1000, late: str = "10 seconds", seen: list | None = None) -> DataFrame:
    """Co-activations of events (EVENTS; views and clicks with purchases) that arrive in portions, a restart after each.

    Both sides keep the events of the last window and `late`, not more: what is older is evicted as the watermark moves on, and what
    comes later than it is dropped. seen: gets the progress of each trigger, with the rows in the state and those dropped.
    """
    for portion in portions:
        portion.write.mode("append").parquet(f"{folder}/in")
        side = lambda f: events(spark, f"{folder}/in", 1_000_000).filter(f).select("event_id", F.col("event_type").alias("seed"), "ts")
        joined = co_activations(side("event_type in ('view', 'click')"), side("event_type = 'purchase'"), window_ms, late)
        query = joined.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        if seen is not None:
            seen += query.recentProgress
    return spark.read.parquet(f"{folder}/rows")


def state_rows(spark: SparkSession, folder: str, side: str = "left") -> DataFrame:
    """What a stream-stream join keeps of a side after its last trigger, read back from its state."""
    return spark.read.format("statestore").option("joinSide", side).load(f"{folder}/progress")


def minute_sketches(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """event_type, minute (window), n, sketch (of the values): each event is aggregated once. On a stream, minutes close with the watermark."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("minute"), "event_type").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value").alias("sketch"))


def rolling_rates(rows: DataFrame, late: str = "10 minutes", minutes: int = 5, quantile: float = 0.99) -> DataFrame:
    """event_type, start, n, p99 over 5 minutes that slide by one: of each window, its minutes' counts and quantile sketches merged.

    The value is one of the window's, whose rank differs from the quantile's by 1.7 % of n at most in 99 of 100 windows; below 200
    values it is exact: the smallest value that `quantile` of all do not exceed. A window without values has none.
    """
    once = minute_sketches(rows, late)
    out = once.groupBy(F.window(F.window_time("minute"), f"{minutes} minutes", "1 minute").alias("w"), "event_type").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    p = F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(quantile)))
    return out.select("event_type", F.col("w.start").alias("start"), "n", p.alias("p99"))


def count_into(stream: DataFrame, keys: list[str], folder: str, every: str | None = None) -> StreamingQuery:
    """Start to count the stream's rows per key, each trigger's changed counts into the folder, which driver and executors share.

    every: the time between triggers; without it, what is there is counted and the query ends. A batch that is run
    again after a loss replaces its own rows.
    """

    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    counts = stream.groupBy(*keys).agg(F.count("*").alias("n"))
    writer = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def counted(spark: SparkSession, keys: list[str], folder: str) -> DataFrame:
    """The keys and n as of the last trigger of count_into, of which there must have been one."""
    return spark.read.parquet(f"{folder}/counts").groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def run_to_end(df: DataFrame, folder: str) -> DataFrame:
    """Process what is there and stop; rows, state and progress are kept in the folder, which driver and executors share."""
    query = df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
