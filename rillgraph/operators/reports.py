"""Lists, pages, sinks and roll-ups of what the engine records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.config import CONFIG
from rillgraph.functions.columns import exact_sum
from rillgraph.operators.graph import holding


def listed(rows: DataFrame, starts: dict[str, str | None] | None = None, since: tuple[str, Column] | None = None, until: tuple[str, Column] | None = None, **equal) -> DataFrame:
    """rows where each given column has its value, begins with its prefix or lies in [since, until); what is None is not asked."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    for name, prefix in (starts or {}).items():
        if prefix is not None:
            rows = rows.filter(F.startswith(F.col(name), F.lit(prefix)))
    if since is not None:
        rows = rows.filter(F.col(since[0]) >= since[1])
    return rows.filter(F.col(until[0]) < until[1]) if until is not None else rows


def page(rows: DataFrame, order: list, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page in order; a page has 1 to 100 rows."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(100, limit)))


def containing(rows: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """word and rows whose column holds a word (word, any number) as it is written: % and _ stand for themselves. An empty word is held by none."""
    return holding(rows, column, words.select(F.col("word").alias("keyword")).distinct()).withColumnRenamed("keyword", "word")


def append(rows: DataFrame, folder: str, cut: dict[str, int] | None = None) -> None:
    """Append rows to a log's folder; texts are cut to the given lengths."""
    for name, chars in (cut or {}).items():
        rows = rows.withColumn(name, F.substring(name, 1, chars))
    rows.write.mode("append").parquet(folder)


def param_stats(activated: DataFrame, scores: DataFrame, verdicts: DataFrame, threshold: float = CONFIG.domain_threshold) -> DataFrame:
    """query_id, ripple_depth, activated_count, selected_domains, confidence, direction: a log row per query. verdicts: query_id, confidence, direction."""
    depth = activated.groupBy("query_id").agg(F.max("depth").alias("ripple_depth"), F.count("*").alias("activated_count"))
    chosen = scores.filter(F.col("score") >= threshold).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "domain"))).alias("d"))
    out = depth.join(chosen, "query_id", "left").join(verdicts, "query_id", "left")
    return out.select("query_id", "ripple_depth", "activated_count", F.array_join(F.transform("d", lambda x: x["domain"]), ",").alias("selected_domains"), "confidence", "direction")


def recent(history: DataFrame, n: int = 20) -> DataFrame:
    """The newest n rows of a log."""
    return history.orderBy(F.desc("created_at"), F.desc("query_id")).limit(n)


def top_unmatched(words: DataFrame, n: int = 10) -> DataFrame:
    """word, n: the words (word) that most often matched nothing."""
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def domain_sources(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """domain, sources, nodes, share: how many of a domain's nodes have an edge of their own."""
    named = seeds.filter("type <> 'META' and domain <> ''").select("label", "domain")
    has = edges.select(F.col("source").alias("label"), F.lit(1).alias("__has")).distinct()
    out = named.join(has, "label", "left").groupBy("domain").agg(F.count("__has").alias("sources"), F.count("*").alias("nodes"))
    return out.withColumn("share", F.round(F.least(F.lit(1.0), F.col("sources") / F.col("nodes")), 4))


def core_domain(seeds: DataFrame) -> DataFrame:
    """domain: the one with most nodes, the first by name of several; one row."""
    n = seeds.filter("type <> 'META' and domain <> ''").groupBy("domain").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "domain").limit(1).select("domain")


def goal_usage(goals: DataFrame, size: int = CONFIG.goal_pool) -> DataFrame:
    """status, kind, n, priority, usage: goals by status and kind, their mean weight, and what share of the pool in percent the status' goals take."""
    by = goals.groupBy("status", "kind").agg(F.count("*").alias("n"), exact_sum(F.col("weight")).alias("w"))
    return by.select("status", "kind", "n", F.round(F.col("w") / F.col("n"), 4).alias("priority"), F.round(F.col("n") * 100.0 / size, 2).alias("usage"))


def alerts(edges: DataFrame, monitors: DataFrame, goals: DataFrame, events: DataFrame, as_of: Column, pool: int = CONFIG.goal_pool) -> DataFrame:
    """kind, subject, value: weights above 1.8; monitors (label, metrics map) with conflicts above 10; an open pool above 80 %; channels with more than 5 unprocessed events in 5 minutes."""
    heavy = edges.filter(F.col("weight") > CONFIG.weight_alert).select(F.lit("weight").alias("kind"), F.concat_ws("|", "source", "target").alias("subject"), F.col("weight").alias("value"))
    freq = F.element_at("metrics", F.lit("conflict_frequency"))
    conflict = monitors.filter(freq > CONFIG.conflict_alert).select(F.lit("conflict"), F.regexp_replace("label", "^meta:", ""), freq)
    used = goals.filter(F.col("status").isin("pending", "exploring", "querying_external")).agg(F.count("*").cast("double").alias("n")).filter(F.col("n") > 0.8 * pool).select(F.lit("pool"), F.lit("goals"), "n")
    late = events.filter(~F.col("processed") & (F.col("ts") > as_of - F.expr("INTERVAL 5 MINUTES"))).groupBy("channel").agg(F.count("*").cast("double").alias("n")).filter("n > 5").select(F.lit("channel"), "channel", "n")
    return heavy.unionAll(conflict).unionAll(used).unionAll(late)


def status(seeds: DataFrame, edges: DataFrame, history: DataFrame, candidates: DataFrame) -> DataFrame:
    """part, name, n: the roll-up of all tables: totals, nodes by type, edges by relation, history by domain, pool by status."""
    def by(rows: DataFrame, part: str, name: str) -> DataFrame:
        return rows.groupBy(F.lit(part).alias("part"), F.coalesce(F.nullif(name, F.lit("")), F.lit(CONFIG.unclassified)).alias("name")).agg(F.count("*").alias("n"))

    def total(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("part"), F.lit(name).alias("name"), "n")

    out = total(seeds, "nodes").unionAll(total(edges, "edges")).unionAll(total(history, "queries"))
    return out.unionAll(by(seeds, "type", "type")).unionAll(by(seeds, "domain", "domain")).unionAll(by(edges, "relation", "relation")).unionAll(by(history, "history", "domain")).unionAll(by(candidates, "pool", "status"))
