"""Users: their nodes, their own edges, and how far they are past the cold start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.config import CONFIG
from rillgraph.functions.columns import clip, cold_factor, user_id

# The domain and the preferences of a new user's node, and what its definition begins with.
USER_DOMAIN = "用户"
FROM = "来源:"
PREFERENCES = {"style": "concise", "level": "expert"}


def resolved(mapping: DataFrame, arrivals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapping, new nodes) after arrivals (source, source_id) of users, any number of times each.

    mapping: source, source_id, user_id. Who is in it keeps the id there; others get one from a digest of both names and a node (label,
    type, domain, definition, preferences map). Two whose digests agree are one node, of the least source. Arrivals without source or id are no user.
    """
    known = mapping.select("source", "source_id", "user_id")
    seen = arrivals.select("source", "source_id").filter("source is not null and source_id is not null").distinct()
    fresh = seen.join(known, ["source", "source_id"], "left_anti").withColumn("user_id", user_id(F.col("source"), F.col("source_id")))
    nodes = fresh.groupBy(F.col("user_id").alias("label")).agg(F.min("source").alias("source")).join(known.select(F.col("user_id").alias("label")), "label", "left_anti")
    likes = F.create_map(*(F.lit(x) for pair in PREFERENCES.items() for x in pair))
    nodes = nodes.select("label", F.lit("USER").alias("type"), F.lit(USER_DOMAIN).alias("domain"), F.concat(F.lit(FROM), "source").alias("definition"), likes.alias("preferences"))
    return known.unionByName(fresh), nodes


def with_own_edges(edges: DataFrame, own: DataFrame) -> DataFrame:
    """edges (source, target, relation, weight) with those that users gave (user_label, target, relation, weight, at): insert or ignore.

    An edge that is there stays as it is; of several new ones of a key the earliest counts, of equal times the least weight. Weights are
    clipped to the bounds; rows without a key or weight are left out.
    """
    key = ["source", "target", "relation"]
    given = own.select(F.col("user_label").alias("source"), "target", "relation", "weight", "at").dropna(subset=[*key, "weight"])
    first = given.groupBy(*key).agg(F.min(F.struct(F.isnull("at").alias("late"), "at", "weight")).alias("m")).select(*key, clip(F.col("m.weight")).alias("weight"))
    return edges.select(*key, "weight").unionByName(first.join(edges.select(*key), key, "left_anti"))


def cold_state(users: DataFrame, counted: DataFrame, personal: DataFrame, per_query: int = CONFIG.max_pairs) -> DataFrame:
    """user_label, queries, cold, factor, estimated for each of users (user_label); counted: user_label, queries.

    A user whose count is lost is estimated: a query adds at most `per_query` personal edges, so it is their number over that, rounded down.
    """
    edges = personal.groupBy("user_label").agg(F.count("*").alias("__edges"))
    out = users.select("user_label").distinct().join(counted.groupBy("user_label").agg(F.max("queries").alias("__n")), "user_label", "left").join(edges, "user_label", "left")
    guess = F.floor(F.coalesce("__edges", F.lit(0)) / max(per_query, 1))
    n = F.coalesce(F.col("__n"), guess).cast("long")
    return out.select("user_label", n.alias("queries"), (n < CONFIG.cold_start_queries).alias("cold"), cold_factor(n).alias("factor"), F.isnull("__n").alias("estimated"))
