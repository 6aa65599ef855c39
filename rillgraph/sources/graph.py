"""The weighted graph over the input tables: nodes (seeds), typed edges, and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.functions.columns import step_weight
from rillgraph.session import dealt, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def key(kind: str, column: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, type, domain, definition: regions, nations, suppliers, customers (USER), parts, brands."""
    t = lambda name: table(spark, sf_dir, name)
    part = t("part")
    brands = part.groupBy("p_brand", "p_type").count().groupBy("p_brand").agg(F.min_by("p_type", F.struct(-F.col("count"), F.col("p_type"))).alias("domain"))
    parts = [
        t("region").select(key("region", "r_regionkey").alias("label"), F.lit("CONCEPT").alias("type"), F.lit("geo").alias("domain"), F.col("r_name").alias("definition")),
        t("nation").select(key("nation", "n_nationkey"), F.lit("CONCEPT"), F.lit("geo"), F.col("n_name")),
        t("supplier").select(key("supplier", "s_suppkey"), F.lit("CONCEPT"), F.lit(""), F.col("s_name")),
        t("customer").select(key("user", "c_custkey"), F.lit("USER"), F.lit(""), F.col("c_name")),
        part.select(key("part", "p_partkey"), F.lit("CONCEPT"), F.col("p_type"), F.col("p_name")),
        brands.select(key("brand", "p_brand"), F.lit("CONCEPT"), F.col("domain"), F.lit("")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def ordered(lines: DataFrame) -> DataFrame:
    """l_orderkey, l_partkey: the distinct parts of each order, dealt by order to tasks that number as the lines do."""
    rows = lines.count()
    spread(lines.sparkSession, rows)
    return dealt(lines.select("l_orderkey", "l_partkey"), rows, "l_orderkey").distinct()


def cooccurrence(lines: DataFrame) -> DataFrame:
    """(a, b, n): ordered pairs of parts that n orders share, n of 2 or more. An order has few lines, so pairs stay few.

    Lines are dealt by order once, which serves the distinct and both sides of the join. Pairs are counted one way round and turned at the end.
    """
    items = ordered(lines)
    other = items.select("l_orderkey", F.col("l_partkey").alias("b"))
    pairs = items.join(other, "l_orderkey").filter("l_partkey < b").groupBy(F.col("l_partkey").alias("a"), "b").agg(F.count("*").alias("n")).filter("n >= 2")
    return pairs.select(F.inline(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n"))))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that leave parts: IS_A to the brand, COOCCURS_WITH between parts."""
    pairs = cooccurrence(table(spark, sf_dir, "lineitem"))
    weight = F.when(F.col("n") >= 4, 0.7).when(F.col("n") == 3, 0.5).otherwise(0.3)
    together = pairs.select(key("part", "a").alias("source"), key("part", "b").alias("target"), F.lit("COOCCURS_WITH").alias("relation"), weight.alias("weight"))
    is_a = table(spark, sf_dir, "part").select(key("part", "p_partkey"), key("brand", "p_brand"), F.lit("IS_A"), F.lit(0.8))
    return together.unionAll(is_a)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, relation, weight: all edges."""
    t = lambda name: table(spark, sf_dir, name)
    avg = F.sum(F.col("l_discount").cast("decimal(10,4)")).cast("double") / F.count("*")
    lines = t("lineitem")
    supplied = dealt(lines.select("l_suppkey", "l_partkey", "l_discount"), lines.count(), "l_suppkey", "l_partkey")
    has = supplied.groupBy("l_suppkey", "l_partkey").agg(step_weight(F.round(1 - avg, 6)).alias("weight"))
    located = F.lit("LOCATED_IN")
    return (
        part_edges(spark, sf_dir)
        .unionAll(t("nation").select(key("nation", "n_nationkey"), key("region", "n_regionkey"), located, F.lit(0.8)))
        .unionAll(t("supplier").select(key("supplier", "s_suppkey"), key("nation", "s_nationkey"), located, F.lit(0.8)))
        .unionAll(t("customer").select(key("user", "c_custkey"), key("nation", "c_nationkey"), located, F.lit(0.8)))
        .unionAll(has.filter("weight > 0").select(key("supplier", "l_suppkey"), key("part", "l_partkey"), F.lit("HAS"), F.col("weight")))
    )


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, label: every order is a query, matched to its distinct parts."""
    return ordered(table(spark, sf_dir, "lineitem")).select(F.col("l_orderkey").alias("query_id"), key("part", "l_partkey").alias("label"))


def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_label, source, target, relation, weight: a customer's own weights on IS_A edges of the parts it ordered twice or more."""
    lines = ordered(table(spark, sf_dir, "lineitem")).withColumnRenamed("l_orderkey", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    often = lines.join(orders, "o_orderkey").groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n")).filter("n >= 2")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    weight = F.least(F.lit(2.0), F.lit(0.5) + F.col("n") * 0.1)
    return often.join(part, "l_partkey").select(key("user", "o_custkey").alias("user_label"), key("part", "l_partkey").alias("source"), key("brand", "p_brand").alias("target"), F.lit("IS_A").alias("relation"), weight.alias("weight"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a query log: query_id, created_at, user_id, domain, confidence, conflict, direction."""
    e = table(spark, sf_dir, "events")
    confidence = F.least(F.lit(1.0), F.col("value") / 100)
    direction = F.when(confidence >= 0.7, 1).when(confidence < 0.3, -1).otherwise(0)
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("query_id"), F.col("ts").alias("created_at"), "user_id", F.col("event_type").alias("domain"), confidence.alias("confidence"), direction.alias("direction"), k.alias("k"))
