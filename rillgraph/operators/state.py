"""Small states as columns and merges: metric maps, execution logs, preferences, goals of absent users, triple import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillgraph.functions.columns import cycles_since, prefixed

# What relations are called in answers.
RELATION_NAMES = {
    "IS_A": "是一种", "PART_OF": "是...的组成部分", "RELATED": "与...相关", "COOCCURS_WITH": "常与...共现", "CAUSE": "导致", "HAS": "拥有",
    "DEFINED_AS": "定义为", "LOCATED_IN": "位于", "BEFORE": "先于", "FOLLOWS": "跟随", "HAS_SUBEVENT": "包含子事件", "HAS_CAPABILITY": "具备能力",
    "HAS_PROPERTY": "具有属性", "MADE_OF": "由...构成", "PAR": "是...的一部分", "COOCCURS_IN": "在...中共现", "SYNONYM": "别名",
}

# Words of a label that name a sound; all other labels are taken as visual.
SOUND_WORDS = ("声音", "频率", "音调", "节奏")
SIGHT_WORDS = ("红色", "绿色", "蓝色", "颜色", "亮度", "暗", "边缘")


def relation_name(relation: Column) -> Column:
    """The display name of a relation; unknown ones keep their own."""
    names = F.create_map(*(F.lit(x) for pair in RELATION_NAMES.items() for x in pair))
    return F.coalesce(F.element_at(names, relation), relation)


def percept_of(label: Column) -> Column:
    """The perception node that a concept's label suggests; words of sight come before words of sound."""
    sight, sound = label.rlike("|".join(SIGHT_WORDS)), label.rlike("|".join(SOUND_WORDS))
    return prefixed(F.concat(F.when(sound & ~sight, F.lit("auditory:")).otherwise(F.lit("visual:")), label), "percept:")


def merged_metrics(old: DataFrame, new: DataFrame, add: bool = False) -> DataFrame:
    """label, metric, value after new ones (label, metric, value): replaced, or with `add` increased; several of a metric add up."""
    given = new.groupBy("label", "metric").agg(F.sum(F.col("value").cast("decimal(28,9)")).cast("double").alias("__new"))
    value = F.coalesce("value", F.lit(0.0)) + F.coalesce("__new", F.lit(0.0)) if add else F.coalesce("__new", "value")
    return old.join(given, ["label", "metric"], "full_outer").select("label", "metric", value.alias("value"))


def appended_log(old: DataFrame, new: DataFrame, keep: int = 20) -> DataFrame:
    """Log entries (goal_id, at, entry_id, entry) of both, the newest `keep` per goal."""
    order = W.partitionBy("goal_id").orderBy(F.desc("at"), F.desc("entry_id"))
    return old.unionByName(new).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= keep).drop("__n")


def merged_preferences(old: Column, new: Column) -> Column:
    """Two maps as one; of keys in both, the new value holds. Null maps are empty."""
    none = F.expr("map()").cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def archive_absent(goals: DataFrame, users: DataFrame, as_of: Column, cycles: int) -> DataFrame:
    """goals (goal_id, user_label, status): open ones of users who were away for `cycles` minutes, or never there, are archived. users: user_label, last_active."""
    seen = users.groupBy("user_label").agg(F.max("last_active").alias("__last"))
    away = F.coalesce(cycles_since(as_of, F.col("__last")) >= cycles, F.lit(True))
    status = F.when(F.col("status").isin("pending", "exploring") & away, "archived").otherwise(F.col("status"))
    return goals.join(seen, "user_label", "left").withColumn("status", status).drop("__last")


def explored(goals: DataFrame, outcomes: DataFrame, as_of: Column, done_weight: float = 0.1) -> DataFrame:
    """goals (goal_id, domain, status, weight, touched) after outcomes (goal_id, status): touched now; completed ones weigh done_weight."""
    o = outcomes.select("goal_id", F.col("status").alias("__to"))
    out = goals.join(o, "goal_id", "left")
    weight = F.when(F.col("__to") == "completed", F.lit(done_weight)).otherwise(F.col("weight"))
    touched = F.when(F.col("__to").isNotNull(), as_of).otherwise(F.col("touched"))
    return out.withColumns({"status": F.coalesce("__to", "status"), "weight": weight, "touched": touched}).drop("__to")


def taxonomy_triples(triples: DataFrame, least: float = 0.5, weight: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, aliases) of triples (s, relation, o, c): IS_A from `least` on makes edges and nodes, SYNONYM aliases of s."""
    sure = triples.filter(F.col("c") >= least)
    is_a = sure.filter("relation = 'IS_A'").select(F.col("s").alias("source"), F.col("o").alias("target"), "relation").distinct()
    nodes = is_a.select(F.col("source").alias("label")).union(is_a.select("target")).distinct()
    aliases = sure.filter("relation = 'SYNONYM'").groupBy(F.col("s").alias("label")).agg(F.array_sort(F.collect_set("o")).alias("aliases"))
    return nodes, is_a.withColumn("weight", F.lit(weight)), aliases


def backfilled(seeds: DataFrame, inferred: DataFrame) -> DataFrame:
    """seeds with blank domains filled from inferred (label, inferred)."""
    out = seeds.join(inferred.select("label", F.col("inferred").alias("__d")), "label", "left")
    return out.withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), "__d", F.lit(""))).drop("__d").select(*seeds.columns)
