"""Learning as functional merges: new_state = merge(old_state, delta), each a full outer join or one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillgraph.config import CONFIG
from rillgraph.functions.columns import clip
from rillgraph.operators.graph import holding

# Fixed value: who contributes what an outside source gives.
ENGINE = "system:curiosity"
EDGE = ["source", "target", "relation"]


def adjust(edges: DataFrame, deltas: DataFrame, start: float = CONFIG.default_weight, key: list[str] | None = None) -> DataFrame:
    """Edges after deltas (key, delta, n sightings): clip(weight + n * delta), from `start` where the edge is new."""
    key = key or EDGE
    total = deltas.groupBy(*key).agg(F.sum(F.round("delta", 9).cast("decimal(28,9)")).cast("double").alias("__d"))
    out = edges.join(total, key, "full_outer")
    value = F.coalesce("weight", F.lit(start)) + F.coalesce("__d", F.lit(0.0))
    return out.withColumn("weight", F.when(F.col("__d").isNull(), F.col("weight")).otherwise(clip(F.round(value, 9)))).drop("__d")


def path_deltas(paths: DataFrame, verdicts: DataFrame) -> DataFrame:
    """query_id, edge, delta: +-.01 on each learning path of a query that was reinforced or corrected."""
    d = verdicts.filter("direction <> 0").select("query_id", (F.col("direction") * CONFIG.weight_delta).alias("delta"))
    return paths.join(d, "query_id").select("query_id", *EDGE, "delta")


def pool(submissions: DataFrame, distinct_users: bool = False) -> DataFrame:
    """Candidate edges from submissions (user_label, edge): canonical triple, count, contributors, status.

    The pair is canonical in code point order for symmetric relations. A candidate seen often enough is upgraded.
    """
    symmetric = F.col("relation").isin("RELATED", "COOCCURS_WITH")
    a, b = F.least("source", "target"), F.greatest("source", "target")
    s = submissions.withColumns({"source": F.when(symmetric, a).otherwise(F.col("source")), "target": F.when(symmetric, b).otherwise(F.col("target"))})
    out = s.groupBy(*EDGE).agg(F.count("*").alias("count"), F.array_sort(F.collect_set("user_label")).alias("contributors"))
    enough = (F.size("contributors") if distinct_users else F.col("count")) >= CONFIG.pool_threshold
    return out.withColumn("status", F.when(enough, "upgraded").otherwise("pending"))


def upgrade(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Edges with upgraded candidates: at least the pool weight."""
    c = candidates.filter("status = 'upgraded'").select(*EDGE).withColumn("__up", F.lit(True))
    out = edges.join(c, EDGE, "full_outer")
    return out.withColumn("weight", F.when(F.col("__up"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(CONFIG.pool_weight))).otherwise(F.col("weight"))).drop("__up")


def pool_in_domain(candidates: DataFrame, seeds: DataFrame, domain: str) -> DataFrame:
    """Pending candidates with either end in the domain; the candidates are made once, not for each end."""
    d = seeds.filter(F.col("domain") == domain).select("label").distinct()
    within = lambda end: d.select(F.col("label").alias(end), F.lit(True).alias(f"__{end}"))
    pending = candidates.filter("status = 'pending'").select(*EDGE, "count")
    return pending.join(within("source"), "source", "left").join(within("target"), "target", "left").filter("__source or __target").select(*EDGE, "count").distinct()


def upgrade_in_domains(edges: DataFrame, candidates: DataFrame, seeds: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, pool) after all pending candidates with an end in one of the domains (domain) were upgraded, whatever their count.

    Where a domain has no such candidate, the domains that hold it as a part of their name stand in for it. Names are compared as they are
    written; an empty or null one asks for nothing.
    """
    pending = candidates.filter("status = 'pending'").select(*EDGE)
    ends = pending.select(*EDGE, F.explode(F.array("source", "target")).alias("label"))
    placed = ends.join(seeds.filter("domain <> ''").select("label", "domain").distinct(), "label").select(*EDGE, "domain").distinct()
    asked = domains.filter("domain <> ''").select(F.col("domain").alias("keyword")).distinct()
    held = holding(placed.select("domain").distinct(), "domain", asked).withColumn("same", F.col("domain") == F.col("keyword"))
    exact = held.filter("same").select("keyword")
    chosen = held.join(exact.withColumn("__exact", F.lit(True)), "keyword", "left").filter("same or __exact is null").select("domain").distinct()
    due = placed.join(chosen, "domain", "left_semi").select(*EDGE).distinct().withColumn("__due", F.lit(True))
    after = candidates.join(due, EDGE, "left")
    after = after.withColumn("status", F.when(F.col("__due") & (F.col("status") == "pending"), "upgraded").otherwise(F.col("status"))).drop("__due")
    return upgrade(edges, due.withColumn("status", F.lit("upgraded"))), after


def submit_external(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """The pool (edge, count, contributors, status) after what an outside source gave: found (label, domain), one row each time.

    Each is a candidate that label is DEFINED_AS domain. One that is there gains its count and keeps contributors and status; a new one is
    pending, with the engine as its contributor. Rows without label or domain are left out.
    """
    n = found.filter("label is not null and domain is not null").groupBy(F.col("label").alias("source"), F.col("domain").alias("target")).agg(F.count("*").alias("__n"))
    out = candidates.join(n.withColumn("relation", F.lit("DEFINED_AS")), EDGE, "full_outer")
    new = F.when(F.lit(CONFIG.pool_threshold) <= 1, "upgraded").otherwise("pending")
    count = F.coalesce("count", F.lit(0)) + F.coalesce("__n", F.lit(0))
    return out.select(*EDGE, count.alias("count"), F.coalesce("contributors", F.array(F.lit(ENGINE))).alias("contributors"), F.coalesce("status", new).alias("status"))


def cleanup(edges: DataFrame, candidates: DataFrame, least: float = CONFIG.weight_min) -> tuple[DataFrame, DataFrame]:
    """Edges without those below the least weight, and the pool after each of those cost its candidate one count."""
    low = edges.filter(F.col("weight") < least).select(*EDGE).withColumn("__low", F.lit(True))
    cooled = candidates.join(low, EDGE, "left").withColumn("count", F.col("count") - F.when(F.col("__low"), 1).otherwise(0))
    status = F.when(F.col("__low") & (F.col("count") < CONFIG.pool_threshold), "cooled").otherwise(F.col("status"))
    return edges.filter(F.col("weight") >= least), cooled.withColumn("status", status).drop("__low")


def alias_stats(events: DataFrame) -> DataFrame:
    """keyword, seed, ref_count, total_count, rate from events (keyword, seed or null): each event counts in every row of its keyword."""
    total = events.groupBy("keyword").agg(F.count("*").alias("total_count"))
    refs = events.filter("seed is not null").groupBy("keyword", "seed").agg(F.count("*").alias("ref_count"))
    out = total.join(refs, "keyword", "left")
    return out.select("keyword", F.coalesce("seed", F.lit("__none__")).alias("seed"), F.coalesce("ref_count", F.lit(0)).alias("ref_count"), "total_count", (F.coalesce("ref_count", F.lit(0)) / F.col("total_count")).alias("rate"))


def alias_decisions(stats: DataFrame, aliases: DataFrame) -> DataFrame:
    """stats with decision: few, low, already, conflict or aliased, in this order. A second seed within the margin is a conflict."""
    order = W.partitionBy("keyword").orderBy(F.desc("rate"), "seed")
    ranked = stats.withColumns({"rn": F.row_number().over(order), "__first": F.first("rate").over(order), "__second": F.nth_value("rate", 2).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    other = F.when(F.col("rn") == 1, F.col("__second")).otherwise(F.col("__first"))
    a = aliases.select(F.col("alias").alias("keyword"), F.lit(True).alias("__has"))
    out = ranked.join(a, "keyword", "left")
    decision = (
        F.when((F.col("total_count") < CONFIG.alias_min_count) | (F.col("seed") == "__none__"), "few").when(F.col("rate") < CONFIG.alias_rate, "low").when(F.col("__has"), "already")
        .when(F.coalesce(F.abs(F.col("rate") - other) < CONFIG.alias_margin, F.lit(False)), "conflict").otherwise("aliased")
    )
    return out.select("keyword", "seed", "ref_count", "total_count", "rate", decision.alias("decision"))


def append_aliases(seeds: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, done) after decisions (keyword, seed, decision): seeds (label, aliases, ...) gain the keywords that were aliased to them.

    New aliases follow the old ones in the order of their names; one that is there is not added again, but is done as well. A null list is
    empty. done: keyword, seed whose node is there; a decision for no node changes nothing.
    """
    due = decisions.filter("decision = 'aliased'").select("keyword", F.col("seed").alias("label")).distinct()
    more = due.groupBy("label").agg(F.array_sort(F.collect_set("keyword")).alias("__more"))
    old = F.coalesce("aliases", F.expr("cast(array() as array<string>)"))
    out = seeds.join(more, "label", "left").withColumn("aliases", F.when(F.col("__more").isNull(), F.col("aliases")).otherwise(F.concat(old, F.array_except("__more", old)))).drop("__more")
    return out, due.join(seeds.select("label").distinct(), "label").select("keyword", F.col("label").alias("seed"))


def candidates(sightings: DataFrame, known: DataFrame, least: int = CONFIG.candidate_min) -> DataFrame:
    """label, count, candidate_since, last_seen for words seen often enough that are no node, alias or candidate yet. sightings: label, seen_at."""
    out = sightings.groupBy("label").agg(F.count("*").alias("count"), F.min("seen_at").alias("candidate_since"), F.max("seen_at").alias("last_seen"))
    return out.filter(F.col("count") >= least).join(known.select("label"), "label", "left_anti")


def majority_domain(links: DataFrame) -> DataFrame:
    """label, domain: the most frequent domain of co-occurring nodes; ties to the first by pos; none is unclassified. links: label, domain, pos."""
    n = links.filter("domain <> ''").groupBy("label", "domain").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    best = n.groupBy("label").agg(F.max_by("domain", F.struct("n", -F.col("pos"), "domain")).alias("domain"))
    return links.select("label").distinct().join(best, "label", "left").select("label", F.coalesce("domain", F.lit(CONFIG.unclassified)).alias("domain"))


def promotion_edges(promoted: DataFrame, edges: DataFrame) -> DataFrame:
    """New RELATED edges both ways between promoted labels and their co-occurring nodes (label, seeds array), unless an edge is there."""
    pairs = promoted.select("label", F.explode("seeds").alias("seed"))
    both = pairs.select(F.col("label").alias("source"), F.col("seed").alias("target")).unionAll(pairs.select("seed", "label")).distinct()
    both = both.withColumns({"relation": F.lit("RELATED"), "weight": F.lit(CONFIG.candidate_weight)})
    return both.join(edges.select(*EDGE), EDGE, "left_anti")


def promote(candidates_: DataFrame, seeds: DataFrame, edges: DataFrame, as_of: Column, least: int = CONFIG.candidate_promote) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, new nodes, new edges) after a promotion of open candidates (label, count, status, promoted_at, seeds array) seen `least` times.

    A promoted label becomes a node (label, domain, definition, activation_bias) with the domain of most of the nodes it was seen with,
    unless there is one of that label, and is linked with these nodes both ways; its candidate is promoted at as_of, others stay.
    """
    due = (F.col("status") == "candidate") & (F.col("count") >= least)
    ready = candidates_.filter(due).select("label", "seeds")
    seen = ready.select("label", F.posexplode_outer("seeds").alias("pos", "seed"))
    domains = seeds.select(F.col("label").alias("seed"), "domain")
    named = majority_domain(seen.join(domains, "seed", "left").select("label", F.coalesce("domain", F.lit("")).alias("domain"), "pos"))
    nodes = named.join(seeds.select("label"), "label", "left_anti").select("label", "domain", F.lit("").alias("definition"), F.lit(CONFIG.candidate_weight).alias("activation_bias"))
    out = candidates_.withColumns({"promoted_at": F.when(due, as_of).otherwise(F.col("promoted_at")), "status": F.when(due, "promoted").otherwise(F.col("status"))})
    return out, nodes, promotion_edges(ready, edges)


def expiry(rows: DataFrame, as_of: Column) -> DataFrame:
    """candidate rows with action: purge after 90 days since promotion or candidacy, expire after 30 days unseen, keep."""
    old = F.coalesce("promoted_at", "candidate_since") < as_of - F.expr(f"INTERVAL {CONFIG.candidate_purge_days} DAYS")
    unseen = F.col("last_seen") < as_of - F.expr(f"INTERVAL {CONFIG.candidate_expire_days} DAYS")
    return rows.withColumn("action", F.when(old, "purge").when(unseen, "expire").otherwise("keep"))


def rollback(current: DataFrame, snapshot: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """The snapshot; or, for listed edges only, their weight in it, and their absence where it lacks them."""
    if listed is None:
        return snapshot
    return current.join(listed.select(*EDGE), EDGE, "left_anti").unionByName(snapshot.join(listed.select(*EDGE), EDGE, "left_semi"))


def erase_user(personal: DataFrame, candidates_: DataFrame, user: str) -> tuple[DataFrame, DataFrame]:
    """Personal edges and pool without a user's part."""
    return personal.filter(F.col("user_label") != user), candidates_.withColumn("contributors", F.array_remove("contributors", user))


def reliability(domains: DataFrame, store: DataFrame) -> DataFrame:
    """domain, score: the stored score within 0..1, .7 where there is none."""
    s = store.select("domain", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("__s"))
    return domains.join(s, "domain", "left").select("domain", F.coalesce("__s", F.lit(CONFIG.reliability)).alias("score"))
