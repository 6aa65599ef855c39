"""Queries that run streams over the tables to their end: rules and learning with state, several triggers and restarts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.plans.graph_queries import ORACLES, query
from rillgraph.plans.learning_queries import LEARN, VERDICTS, _paths
from rillgraph.plans.sql import MATCHED, PART_EDGES, PERSONAL, ripple, with_
from rillgraph.session import fresh_path
from rillgraph.sources import graph as S
from rillgraph.streaming import binding as B
from rillgraph.streaming import learning, limits

CALLS = "event_id long, key long, ts timestamp, failed boolean"
#: Days of events that arrive together; what one trigger meets.
DAYS = 8


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, limits.ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _judged(spark: SparkSession, sf: str, rule: limits.Rule) -> DataFrame:
    """The rule over all events, which arrive in portions of eight days, with a restart after each."""
    folder = fresh_path(spark, "judged")
    rows = S.table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 60).alias("failed"))
    part = F.floor(F.dayofmonth("ts") / DAYS)
    # the last arrival only moves the watermark past all events
    ends = rows.agg(F.max("ts").alias("t")).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), "t").select((-F.col("n")).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("key"), (F.col("t") + F.col("n") * F.expr("INTERVAL 10 DAYS")).alias("ts"), F.lit(False).alias("failed"))
    kind = F.col("event_id") >= 0
    with _rocks(spark):
        for portion in (*(rows.filter(part == i) for i in range(31 // DAYS + 1)), ends.filter("event_id = -1"), ends.filter("event_id = -2")):
            portion.write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(CALLS).parquet(f"{folder}/in")
            out = limits.judged(stream, rule, "1 minute").writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
            out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").filter(kind)


@query(ORACLES["rate_limit_fixed"])
def stream_rate_limit(spark, sf):
    """Two requests a user and day, judged as they come."""
    return _judged(spark, sf, limits.Window(2, 86_400))


@query(ORACLES["circuit_breaker"])
def stream_breaker(spark, sf):
    """Breakers that open after three failures of a user, kept as they come."""
    return _judged(spark, sf, limits.Breaker(3, 86_400))


LATE = """
e AS (SELECT event_id, event_type, epoch_us(ts) AS t, event_id % 20 = 7 AND ts < (SELECT max(ts) FROM events) - INTERVAL 2 DAYS AS late FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""


@query("WITH " + LATE + """
SELECT p.event_id AS percept_id, c.event_id AS concept_id, p.event_type AS percept, c.event_type AS concept
FROM e p JOIN e c ON p.t - c.t BETWEEN -60000000 AND 60000000 WHERE NOT p.late AND NOT c.late AND p.event_type IN ('view', 'click') AND c.event_type = 'purchase'""")
def stream_late(spark, sf):
    """Co-activation with a watermark of one hour: a day's events arrive in order, one event in twenty days too late, and meets nothing."""
    e = S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("last"))))  # one row
    late = (F.col("event_id") % 20 == 7) & (F.col("ts") < F.col("last") - F.expr("INTERVAL 2 DAYS"))
    part = F.floor(F.dayofmonth("ts") / DAYS)
    portions = (*(e.filter(~late & (part == i)) for i in range(31 // DAYS + 1)), e.filter(late))
    return B.joined_in_portions(spark, [p.drop("last") for p in portions], fresh_path(spark, "late"), 60_000, "1 hour")


def _by_thirds(what: str, key: str, start: str, first: str) -> str:
    """SQL of a layer after three batches, each clipped: sums of the batches' deltas over the layer at the start."""
    keys = key.split(", ")
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    out = f"{what}0 AS (SELECT {key}, weight FROM {start})"
    for i in range(3):
        sums = f"SELECT {key}, sum(round(delta, 9)::DECIMAL(28,9))::DOUBLE AS d FROM given WHERE query_id % 3 = {i} AND {first} GROUP BY {key}"
        out += f""",
{what}{i + 1} AS MATERIALIZED (SELECT {', '.join(f'coalesce(w.{k}, d.{k}) AS {k}' for k in keys)}, CASE WHEN d.d IS NULL THEN weight ELSE greatest(0.01::DOUBLE, least(2.0::DOUBLE, round(coalesce(weight, 0.5) + d.d, 9))) END AS weight
  FROM {what}{i} w FULL JOIN ({sums}) d ON {on('w', 'd')})"""
    return out


@query(with_(PART_EDGES, MATCHED, ripple(2), LEARN, VERDICTS, PERSONAL) + """,
given AS MATERIALIZED (SELECT query_id, CASE WHEN query_id % 7 > 1 THEN user_label END AS user_label, source, target, relation, delta FROM deltas),
""" + _by_thirds("p", "user_label, source, target, relation", "personal", "user_label IS NOT NULL") + ",\n" + _by_thirds("l", "source, target, relation", "part_edges", "user_label IS NULL") + """,
pool AS (SELECT source, target, relation, count(*) AS n, string_agg(DISTINCT user_label, ',' ORDER BY user_label) AS contributors FROM given WHERE user_label IS NOT NULL GROUP BY 1, 2, 3)
SELECT 'personal' AS part, user_label, source, target, relation, round(weight, 6) AS weight, NULL::BIGINT AS count, NULL AS contributors FROM p3
UNION ALL SELECT 'layer', NULL, source, target, relation, round(weight, 6), NULL, NULL FROM l3
UNION ALL SELECT 'pool', NULL, source, target, relation, NULL, n, contributors FROM pool""")
def karma_stream(spark, sf):
    """Learning in three batches, the last of them run twice: personal layer, pool and global layer."""
    folder = fresh_path(spark, "karma")
    orders = S.table(spark, sf, "orders")
    price, user = F.col("o_totalprice"), S.key("user", "o_custkey")
    v = orders.select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderkey") % 7 > 1, user).alias("user_label"), F.when(price > 200000, 1).when(price < 50000, -1).otherwise(0).alias("direction"))
    paths = _paths(spark, sf).join(v.filter("direction <> 0"), "query_id").select("query_id", "user_label", "direction", "source", "target", "relation")
    paths.withColumn("third", F.col("query_id") % 3).write.partitionBy("third").parquet(f"{folder}/paths")
    memory = learning.Memory(spark, f"{folder}/memory")
    memory.start(S.part_edges(spark, sf), S.personal(spark, sf))
    for third in range(3):
        spark.read.schema(learning.VERDICT).parquet(f"{folder}/paths/third={third}").write.mode("append").parquet(f"{folder}/in")
        learning.learn_into(spark.readStream.schema(learning.VERDICT).parquet(f"{folder}/in"), memory, f"{folder}/progress").awaitTermination()
    memory.apply(spark.read.schema(learning.VERDICT).parquet(f"{folder}/paths/third=2"), 3)
    none = lambda kind: F.lit(None).cast(kind)
    edge, weight = ["source", "target", "relation"], F.round("weight", 6).alias("weight")
    out = memory.personal.read().select(F.lit("personal").alias("part"), "user_label", *edge, weight, none("long").alias("count"), none("string").alias("contributors"))
    out = out.unionByName(memory.layer.read().select(F.lit("layer").alias("part"), none("string").alias("user_label"), *edge, weight, none("long").alias("count"), none("string").alias("contributors")))
    return out.unionByName(memory.pool.read().select(F.lit("pool").alias("part"), none("string").alias("user_label"), *edge, none("double").alias("weight"), "count", F.array_join("contributors", ",").alias("contributors")))


@query(with_(PART_EDGES) + """,
one AS (SELECT source, target, relation, CASE WHEN relation = 'IS_A' THEN weight + 0.1::DOUBLE ELSE weight END AS weight FROM part_edges WHERE NOT (relation = 'COOCCURS_WITH' AND weight > 0.5))
SELECT 'changed' AS version, * FROM one UNION ALL SELECT 'rolled back', source, target, relation, weight FROM part_edges
UNION ALL SELECT 'restored', p.source, p.target, p.relation, CASE WHEN p.relation = 'IS_A' AND p.source NOT LIKE '%7' THEN p.weight + 0.1::DOUBLE ELSE p.weight END FROM part_edges p WHERE NOT (p.relation = 'COOCCURS_WITH' AND p.weight > 0.5)""")
def version_log(spark, sf):
    """Edges as a log of versions: changed and partly removed, rolled back, changed again and some keys restored."""
    from rillgraph.sources.versions import GONE, Versions

    log = Versions(spark, fresh_path(spark, "versions"), ["source", "target", "relation"])
    log.write(S.part_edges(spark, sf))
    change = log.read(1).filter("relation = 'IS_A' or weight > 0.5")
    change = change.select("source", "target", "relation", F.when(F.col("relation") == "IS_A", F.col("weight") + 0.1).otherwise(F.col("weight")).alias("weight"), (F.col("relation") != "IS_A").alias(GONE))
    log.change(change)
    log.rollback(1)
    log.change(change)
    log.restore(1, log.read(1).filter("relation = 'IS_A' and source like '%7'"))
    out = None
    for name, number in (("changed", 2), ("rolled back", 3), ("restored", 5)):
        part = log.read(number).select(F.lit(name).alias("version"), "source", "target", "relation", "weight")
        out = part if out is None else out.unionByName(part)
    return out
