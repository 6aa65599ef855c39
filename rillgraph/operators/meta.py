"""Periodic metrics, monitor nodes, goals, tuning and alerts: every step a pure function of tables and as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.config import CONFIG
from rillgraph.functions.columns import cycles_since, exact_sum, goal_id
from rillgraph.functions.text import round_half


# The monitors of the system as a whole.
SYSTEM_MONITORS = ("system_total_nodes", "system_total_edges", "system_avg_confidence", "system_distillation_rate", "system_seed_growth_rate")


def last_n(history: DataFrame, n: int) -> DataFrame:
    """The newest n rows of a log."""
    return history.orderBy(F.desc("created_at"), F.desc("query_id")).limit(n)


def selection_share(history: DataFrame, n: int = CONFIG.metrics_window) -> DataFrame:
    """domain, share: how often a domain was selected in the last n queries. history: domains array<string>."""
    rows = last_n(history, n)
    total = rows.agg(F.count("*").alias("n"))
    picked = rows.select(F.explode("domains").alias("domain")).groupBy("domain").agg(F.count("*").alias("k"))
    return picked.crossJoin(F.broadcast(total)).select("domain", F.round(F.col("k") / F.col("n"), 6).alias("share"))  # one row of total


def low_confidence(history: DataFrame, n: int = CONFIG.explore_window, below: float = CONFIG.confidence_low, least: float = 0.3) -> DataFrame:
    """domain, rate, queries of domains whose share of low confidences in the last n queries exceeds `least`."""
    rows = last_n(history, n).select(F.explode("domains").alias("domain"), "confidence")
    out = rows.groupBy("domain").agg(F.count("*").alias("queries"), F.count_if(F.col("confidence") < below).alias("low"))
    return out.select("domain", F.round(F.col("low") / F.col("queries"), 6).alias("rate"), "queries").filter(F.col("rate") > least)


def system_metrics(now: DataFrame, before: DataFrame) -> DataFrame:
    """metric, value, change against the previous snapshot (metric, value); what was not there before was 0."""
    return now.join(before.select("metric", F.col("value").alias("__old")), "metric", "left").select("metric", "value", (F.col("value") - F.coalesce("__old", F.lit(0.0))).alias("change"))


def system_values(seeds: DataFrame, edges: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """metric, value of the five system monitors, each one aggregation: nodes and edges but for monitors; of the day before as_of the mean
    confidence (0 without queries), how many queries changed weights, how many nodes came. seeds: type, created_at; history: confidence, direction, created_at."""
    day = (F.col("created_at") > as_of - F.expr("INTERVAL 1 DAY")) & (F.col("created_at") <= as_of)
    plain = seeds.filter("type <> 'META'")
    new = F.count_if(day).cast("double")
    nodes = plain.agg(F.count("*").cast("double").alias("n"), new.alias("d"))
    links = edges.filter(~F.col("source").startswith("meta:")).agg(F.count("*").cast("double").alias("n"))
    log = history.filter(day).agg(F.coalesce(round_half(exact_sum(F.col("confidence")) / F.count("confidence"), 4), F.lit(0.0)).alias("c"), F.count_if(F.col("direction") != 0).cast("double").alias("k"))
    names = dict(zip(("nodes", "edges", "confidence", "changes", "new"), SYSTEM_MONITORS, strict=True))
    rows = nodes.select(F.expr(f"stack(2, '{names['nodes']}', n, '{names['new']}', d) as (metric, value)"))
    rows = rows.unionAll(links.select(F.lit(names["edges"]), "n"))
    return rows.unionAll(log.select(F.expr(f"stack(2, '{names['confidence']}', c, '{names['changes']}', k) as (metric, value)")))


def monitors(seeds: DataFrame, edges: DataFrame, have: DataFrame) -> DataFrame:
    """label, category, source of monitor nodes that are not there yet: one per domain, per relation, and five of the system."""
    d = seeds.filter("domain <> ''").select(F.concat(F.lit("meta:domain:"), "domain").alias("label"), F.lit("domain").alias("category"), F.col("domain").alias("source_domain"))
    r = edges.select(F.concat(F.lit("meta:relation:"), "relation"), F.lit("relation"), F.lit("").alias("s"))
    s = seeds.sparkSession.createDataFrame([(f"meta:{n}", "system", n) for n in SYSTEM_MONITORS], "label string, category string, source_domain string")
    return d.unionAll(r).unionAll(s).distinct().join(have.select("label"), "label", "left_anti")


def monitor_edges(metrics: DataFrame) -> DataFrame:
    """source, target, delta: for each metric that moved by 2 or more, +-.05 to every monitor of the category. metrics: label, category, metric, change.

    Monitors number as the domains and relations do, not as the data.
    """
    moved = metrics.filter(F.abs("change") >= CONFIG.meta_delta).select(F.col("label").alias("source"), "category", (F.signum("change") * CONFIG.meta_weight).alias("delta"))
    peers = metrics.select(F.col("label").alias("target"), "category").distinct()
    return moved.join(peers, "category").filter("source <> target").groupBy("source", "target").agg(F.sum(F.col("delta").cast("decimal(28,9)")).cast("double").alias("delta"))


def dormancy(state: DataFrame) -> DataFrame:
    """Next status of monitors (label, status, unchanged, changed), one step a cycle: dormant after 100 unchanged cycles, from there active on change or retired after 300."""
    n = F.when(F.col("status") == "retired", F.col("unchanged")).when(F.col("changed"), 0).otherwise(F.col("unchanged") + 1)
    status = (
        F.when((F.col("status") == "active") & (n >= CONFIG.dormant_cycles), "dormant").when((F.col("status") == "dormant") & F.col("changed"), "active")
        .when((F.col("status") == "dormant") & (n >= CONFIG.retired_cycles), "retired").otherwise(F.col("status"))
    )
    return state.select("label", status.alias("status"), n.cast("long").alias("unchanged"))


def goals(domains: DataFrame, as_of: Column) -> DataFrame:
    """goal_id, domain, kind: what triggers exploration. domains: domain, low_count, density, avg_density, conflicts."""
    kinds = F.array(
        F.when(F.col("low_count") > CONFIG.goal_low_conf, "low_confidence"),
        F.when(F.col("density") < F.col("avg_density") * CONFIG.goal_density_ratio, "low_density"),
        F.when(F.col("conflicts") > CONFIG.conflict_alert, "high_conflict"),
    )
    out = domains.select("domain", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    return out.select(goal_id(F.col("domain"), F.col("kind"), as_of).alias("goal_id"), "domain", "kind")


def priority(user: Column, core: Column, uncertainty: Column, parts: Column) -> Column:
    """.4 user + .3 coreness + .2 uncertainty + .1 decomposability, within 0..1, two digits."""
    return round_half(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * user + 0.3 * core + 0.2 * uncertainty + 0.1 * parts)), 2)


def _cooled(goals_: DataFrame, as_of: Column) -> DataFrame:
    """goals_ with cooled: the weight of pending goals untouched for 10 cycles after they lose a fifth, to four digits; null for others."""
    stale = (F.col("status") == "pending") & (cycles_since(as_of, F.col("touched")) >= CONFIG.goal_decay_cycles)
    return goals_.withColumn("cooled", F.when(stale, round_half(F.col("weight") * CONFIG.goal_decay, 4)))


def cool(goals_: DataFrame, as_of: Column) -> DataFrame:
    """goal_id, status, weight after a cooling: what was decayed below .05 expires; fresh and closed goals stay as they are."""
    status = F.when(F.col("cooled") < CONFIG.goal_expire, "expired").otherwise(F.col("status"))
    return _cooled(goals_, as_of).select("goal_id", status.alias("status"), F.coalesce("cooled", "weight").alias("weight"))


def evict(goals_: DataFrame, size: int = CONFIG.goal_pool) -> DataFrame:
    """The pool without its lowest and oldest goals beyond the size; open goals only, a bounded pool."""
    return goals_.orderBy(F.desc("weight"), F.desc("touched"), "goal_id").limit(size)


def schedule(goals_: DataFrame) -> DataFrame:
    """Of the three goals with the highest priority, those above .6."""
    return goals_.orderBy(F.desc("weight"), F.desc("touched"), "goal_id").limit(CONFIG.goal_per_cycle).filter(F.col("weight") > CONFIG.goal_explore)


def threshold_grid(history: DataFrame, low: int = 20, high: int = 80, step: int = 5) -> DataFrame:
    """threshold, fp, fn, tp, f1 over a grid: confidence at or above it predicts a positive direction."""
    grid = F.array(*(F.lit(t / 100) for t in range(low, high + 1, step)))
    # each row meets the grid's few thresholds where it is; partial sums go to the shuffle
    counted = history.withColumn("threshold", F.explode(grid)).groupBy("threshold")
    yes, good = F.col("confidence") >= F.col("threshold"), F.col("direction") > 0
    out = counted.agg(F.count_if(yes & good).alias("tp"), F.count_if(yes & ~good).alias("fp"), F.count_if(~yes & good).alias("fn"))
    return out.withColumn("f1", F.round(F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0)), 6))


def pick_best(grid: DataFrame, value: str, metric: str) -> DataFrame:
    """The value with the highest metric; the smallest wins ties."""
    return grid.agg(F.max_by(value, F.struct(metric, -F.col(value))).alias(value), F.max(metric).alias(metric))


def alerts(edges: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """kind, subject, value: weights above 1.8, conflicts above 10, channels with more than 5 events in 5 minutes."""
    heavy = edges.filter(F.col("weight") > CONFIG.weight_alert).select(F.lit("weight").alias("kind"), F.concat_ws("|", "source", "target", "relation").alias("subject"), F.col("weight").alias("value"))
    conflict = events.groupBy("domain").agg(F.count_if("conflict").cast("double").alias("value")).filter(F.col("value") > CONFIG.conflict_alert).select(F.lit("conflict"), "domain", "value")
    recent = events.filter(F.col("created_at") >= as_of - F.expr("INTERVAL 5 MINUTES")).groupBy("domain").agg(F.count("*").cast("double").alias("value")).filter("value > 5").select(F.lit("channel"), "domain", "value")
    return heavy.unionAll(conflict).unionAll(recent)


def newest(rows: DataFrame, keep: int) -> DataFrame:
    """checkpoint rows (id, created_at) with keep: the newest ones stay."""
    first = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(keep).select("id", F.lit(True).alias("__kept"))
    return rows.join(first, "id", "left").withColumn("kept", F.coalesce("__kept", F.lit(False))).drop("__kept")


def term_goals(terms: DataFrame, as_of: Column, above: int = CONFIG.goal_low_conf) -> DataFrame:
    """goal_id, domain, kind of unmatched terms (domain, n) seen more than `above` times."""
    often = terms.filter(F.col("n") > above).select("domain", F.lit("new_term").alias("kind")).distinct()
    return often.select(goal_id(F.col("domain"), F.col("kind"), as_of).alias("goal_id"), "domain", "kind")


def merged_goals(have: DataFrame, triggered: DataFrame, as_of: Column) -> DataFrame:
    """goal_id, domain, kind, status, weight, touched: a trigger (goal_id, domain, kind, weight) renews the open goal of its domain and kind, or makes a pending one."""
    new = triggered.select("domain", "kind", F.col("goal_id").alias("__id"), F.col("weight").alias("__w"))
    open_ = have.filter(F.col("status").isin("pending", "exploring")).join(new, ["domain", "kind"], "full_outer")
    hit = F.col("__id").isNotNull()
    open_ = open_.select(
        F.coalesce("goal_id", "__id").alias("goal_id"), "domain", "kind", F.coalesce("status", F.lit("pending")).alias("status"),
        F.when(hit, F.col("__w")).otherwise(F.col("weight")).alias("weight"), F.when(hit, as_of).otherwise(F.col("touched")).alias("touched"),
    )
    closed = have.filter(~F.col("status").isin("pending", "exploring")).select(*open_.columns)
    return open_.unionByName(closed)


def cooling_history(goals_: DataFrame, as_of: Column) -> DataFrame:
    """goal_id, before, after, old_weight, new_weight, reason: a row for each pending goal that a cooling changes."""
    gone = F.col("cooled") < CONFIG.goal_expire
    changed = _cooled(goals_, as_of).filter("cooled is not null")
    return changed.select("goal_id", F.col("status").alias("before"), F.when(gone, "expired").otherwise("pending").alias("after"), F.col("weight").alias("old_weight"), F.col("cooled").alias("new_weight"), F.when(gone, "decay_expire").otherwise("decay").alias("reason"))


def decay_grid(stats: DataFrame, grid: list[float], near: float = 0.1, decay: float = CONFIG.ripple_decay) -> DataFrame:
    """decay, precision of each value of a grid over log rows (decay_factor, ripple_depth, activated_count).

    Rows within `near` of a value speak for it, all rows where there is none. Their mean of depth over the root of the
    count is compared with what it would be at the value.
    """
    close = lambda d: F.abs(F.col("decay_factor") - d) <= near + 1e-9
    use = F.col("activated_count") > 0
    value = F.round(F.col("ripple_depth") / F.sqrt("activated_count"), 9).cast("decimal(28,9)")
    parts = [x for i, d in enumerate(grid) for x in (F.count_if(close(d)).alias(f"c{i}"), F.sum(F.when(use & close(d), value)).alias(f"s{i}"))]
    sums = stats.agg(*parts, F.sum(F.when(use, value)).alias("all"))
    rows = F.array(*(F.struct(F.lit(d).alias("decay"), F.when(F.col(f"c{i}") > 0, F.col(f"s{i}")).otherwise(F.col("all")).alias("total")) for i, d in enumerate(grid)))
    theory = F.lit(decay) / F.col("r.decay")
    precision = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(1 - theory) / theory))
    return sums.select(F.explode(rows).alias("r")).select("r.decay", F.when(F.coalesce(F.col("r.total"), F.lit(0)) == 0, 0.0).otherwise(F.round(precision, 6)).alias("precision"))


def quality_grid(history: DataFrame, grid: list[float], low: float = CONFIG.confidence_low) -> DataFrame:
    """threshold, positive, negative, quality: what shares would be reinforced and corrected at each threshold."""
    rows = history.withColumn("threshold", F.explode(F.array(*map(F.lit, grid)))).groupBy("threshold")
    p, n = F.count_if(F.col("confidence") >= F.col("threshold")), F.count_if((F.col("confidence") < F.col("threshold")) & (F.col("confidence") < low))
    out = rows.agg(p.alias("p"), n.alias("n"), F.count("*").alias("all"))
    quality = F.coalesce(2 * F.col("p") / F.nullif(2 * F.col("p") + F.col("n"), F.lit(0)), F.lit(0.0))
    return out.select("threshold", F.round(F.col("p") / F.col("all"), 6).alias("positive"), F.round(F.col("n") / F.col("all"), 6).alias("negative"), F.round(quality, 6).alias("quality"))
