"""Equivalent candidates of the pool: set-similarity search over neighbourhoods, and merging in the order of submission.

Two candidates are equivalent if the Jaccard similarities of their sources' and of their targets' neighbourhoods multiply to
more than the threshold. Both factors must exceed it then, so equivalent ends are found first, node by node, by an inverted
index of prefixes, and no pair of candidates is formed that does not share similar ends. Nodes with the same neighbourhood are
one class and candidates between the same classes one row, so copies, however many, are never paired.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillgraph.config import CONFIG
from rillgraph.operators.learning import EDGE
from rillgraph.session import Scratch, written

Put = Callable[[DataFrame, str], DataFrame]

# Relations that mean another one.
SAME_RELATION = {"HELPS_WITH": "TREATS", "HELPS": "TREATS", "USED_FOR": "TREATS", "COOCCURS_IN": "COOCCURS_WITH", "PAR": "PART_OF", "SYNONYM": "RELATED"}


def canonical(submissions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """submissions with the relation that theirs means and, given aliases (alias, label; the first label of several), with labels for aliases."""
    relation = F.col("relation")
    for name, means in SAME_RELATION.items():
        relation = F.when(F.col("relation") == name, means).otherwise(relation)
    out = submissions.withColumn("relation", relation)
    if aliases is not None:
        known = aliases.groupBy("alias").agg(F.min("label").alias("__label"))
        for end in ("source", "target"):
            out = out.join(known.withColumnRenamed("alias", end), end, "left").withColumn(end, F.coalesce("__label", end)).drop("__label")
    return out.select(*submissions.columns)


def neighbours(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """label, other: the distinct one-hop neighbours, either way, of labels (label)."""
    both = edges.select(F.col("source").alias("label"), F.col("target").alias("other")).union(edges.select("target", "source"))
    return both.join(labels.select("label").distinct(), "label", "left_semi").distinct()


def classes(members: DataFrame, put: Put = written) -> DataFrame:
    """label, class: labels with equal sets (label, other) have one class, the least of them. Sets are told apart by size and 128 hashed bits."""
    name = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("other").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "other")).alias("x"))
    signed = put(members.groupBy("label").agg(name.alias("name")), "set-names")
    return signed.join(signed.groupBy("name").agg(F.min("label").alias("class")), "name").select("label", "class")


def similar_sets(members: DataFrame, threshold: float, put: Put = written) -> DataFrame:
    """a, b, shared, union for all pairs of sets (label, other; distinct) with a Jaccard similarity above the threshold, once a pair.

    Tokens are ordered from rare to common. Of a pair, the smaller set is met by its first n - floor(2 t n / (1 + t)) tokens and
    the larger one by its first n - floor(t n); these must share a token. So a common token meets sets that consist of little
    else only. Candidates are counted exactly on the full sets.
    """
    t = F.lit(round(threshold * 100)).cast("long")
    sizes = members.groupBy("label").agg(F.count("*").alias("n"))
    often = members.groupBy("other").agg(F.count("*").alias("held")).filter("held > 1")
    # tokens of one set only come first in its order but meet nothing: their number alone is needed
    ranked = members.join(often, "other").withColumn("place", F.row_number().over(W.partitionBy("label").orderBy("held", "other")))
    ranked = ranked.join(ranked.groupBy("label").agg(F.count("*").alias("common")), "label").join(sizes, "label").withColumn("place", F.col("place") + F.col("n") - F.col("common"))
    ranked = put(ranked.select("label", "other", "place", "n"), "set-prefixes")
    small = ranked.filter(F.col("place") <= F.col("n") - F.floor(2 * t * F.col("n") / (t + 100))).select(F.col("label").alias("a"), F.col("n").alias("na"), "other")
    large = ranked.filter(F.col("place") <= F.col("n") - F.floor(t * F.col("n") / 100)).select(F.col("label").alias("b"), F.col("n").alias("nb"), "other")
    fits = (F.struct("na", "a") < F.struct("nb", "b")) & (100 * F.col("na") > t * F.col("nb"))
    met = put(small.join(large, "other").filter(fits).select("a", "na", "b", "nb").distinct(), "set-pairs")
    shared = met.join(members.select(F.col("label").alias("a"), "other"), "a").join(members.select(F.col("label").alias("b"), "other"), ["b", "other"])
    out = shared.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).withColumn("union", F.col("na") + F.col("nb") - F.col("shared"))
    return out.filter(100 * F.col("shared") > t * F.col("union")).select("a", "b", "shared", "union")


def _order(prefix: str = "") -> Column:
    return F.struct(*(f"{prefix}{c}" for c in ("first", *EDGE)))


def leaders(links: DataFrame, put: Put = written) -> DataFrame:
    """key, leader of every key in links (later, earlier; later > earlier): keys are taken in order, each joins the earliest leader that
    it is linked with, and leads itself if there is none.

    A round decides all keys that no undecided earlier key is linked with, and all that are linked with these; rounds are as many as
    the longest chain of dependent decisions, which is short unless links form long ascending paths.
    """
    links = put(links.distinct(), "leader-links")
    open_, led = links, None

    def keys(rows: DataFrame, *names: str) -> DataFrame:
        out = rows.select(F.col(names[0]).alias("key"))
        return (out.union(rows.select(names[1])) if len(names) > 1 else out).distinct()

    while led is None or not open_.isEmpty():
        free = put(keys(open_, "earlier").join(keys(open_, "later"), "key", "left_anti"), "leaders")
        members = put(keys(open_.join(free.withColumnRenamed("key", "earlier"), "earlier", "left_semi"), "later"), "led")
        decided = free.unionByName(members)
        rest = open_.join(members.withColumnRenamed("key", "later"), "later", "left_anti")
        open_ = put(rest.join(decided.withColumnRenamed("key", "earlier"), "earlier", "left_anti"), "leader-open")
        # whose links were all to members has no leader to join
        alone = put(keys(rest, "later", "earlier").join(decided, "key", "left_anti").join(keys(open_, "later", "earlier"), "key", "left_anti"), "leaders")
        led = free.unionByName(alone) if led is None else led.unionByName(free).unionByName(alone)
    joined = links.join(led.withColumnRenamed("key", "earlier"), "earlier").groupBy(F.col("later").alias("key")).agg(F.min("earlier").alias("leader"))
    return joined.join(led, "key", "left_anti").unionByName(led.select("key", F.col("key").alias("leader")))


def merged(candidates: DataFrame, edges: DataFrame, threshold: float = CONFIG.overlap_threshold) -> DataFrame:
    """candidates (first, edge; first orders the submissions) with leader: the candidate (first, edge) that theirs is merged into."""
    with Scratch(candidates.sparkSession) as scratch:
        put = scratch.put
        candidates = put(candidates.select("first", *EDGE), "pool-candidates")
        ends = candidates.select(F.col("source").alias("label")).union(candidates.select("target"))
        near = put(neighbours(edges, ends), "pool-neighbours")
        named = put(classes(near, put), "pool-classes")
        pairs = put(similar_sets(near.join(named.filter("label = class").select("label"), "label", "left_semi"), threshold, put), "pool-similar")
        whole = named.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1).cast("long").alias("shared"), F.lit(1).cast("long").alias("union")).distinct()
        sims = pairs.unionAll(pairs.select("b", "a", "shared", "union")).unionByName(whole)

        of = lambda end: named.select(F.col("label").alias(end), F.col("class").alias(f"{end}_class"))
        placed = put(candidates.join(of("source"), "source").join(of("target"), "target").select(_order().alias("key"), "source_class", "target_class"), "pool-placed")
        heads = put(placed.groupBy("source_class", "target_class").agg(F.min("key").alias("head")), "pool-heads")
        side = lambda c, n: sims.select(F.col("a").alias(f"{c}_class"), F.col("b").alias(f"other_{c}"), F.col("shared").alias(f"shared_{n}"), F.col("union").alias(f"union_{n}"))
        far = heads.join(side("source", 1), "source_class").join(side("target", 2), "target_class")
        product = 100 * F.col("shared_1") * F.col("shared_2") > round(threshold * 100) * F.col("union_1") * F.col("union_2")
        other = heads.select(F.col("source_class").alias("other_source"), F.col("target_class").alias("other_target"), F.col("head").alias("earlier"))
        links = far.filter(product).join(other, ["other_source", "other_target"]).filter("earlier < head").select(F.col("head").alias("later"), "earlier")
        led = leaders(links, put).select(F.col("key").alias("head"), "leader")
        out = placed.join(heads, ["source_class", "target_class"]).select("key", "head").join(led, "head", "left").select("key", F.coalesce("leader", "head").alias("leader"))
        found = candidates.withColumn("key", _order()).join(out, "key", "left")
        return written(found.select("first", *EDGE, F.coalesce("leader", "key").alias("leader")), "pool-leaders")


def merged_pool(submissions: DataFrame, edges: DataFrame, aliases: DataFrame | None = None, threshold: float = CONFIG.overlap_threshold, least: int = CONFIG.pool_threshold) -> DataFrame:
    """edge, count, contributors, merged, status of a pool whose equivalent candidates are one.

    submissions: user_label, edge, at (orders them). A candidate joins the earliest one with its canonical edge or with overlapping
    neighbourhoods; merged is the number of different edges in it. Candidates are compared with all others, upgraded or not.
    """
    rows = canonical(submissions, aliases)
    counts = F.min("at").alias("first"), F.count("*").alias("n"), F.collect_set("user_label").alias("users")
    candidates = written(rows.groupBy(*EDGE).agg(*counts), "pool-submissions")
    found = merged(candidates, edges, threshold).select(*EDGE, "leader")
    users = F.array_sort(F.array_distinct(F.flatten(F.collect_list("users"))))
    out = candidates.join(found, EDGE).groupBy("leader").agg(F.sum("n").alias("count"), users.alias("contributors"), F.count("*").alias("merged"))
    return out.select(*(F.col(f"leader.{c}").alias(c) for c in EDGE), "count", "contributors", "merged", F.when(F.col("count") >= least, "upgraded").otherwise("pending").alias("status"))
