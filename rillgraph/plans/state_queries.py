"""Queries over small states, imports, snapshots and perception."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgraph.functions.columns import html_escaped
from rillgraph.operators import events as E
from rillgraph.operators import graph as G
from rillgraph.operators import perception as P
from rillgraph.operators import state as X
from rillgraph.plans.graph_queries import BLANKED, query
from rillgraph.plans.sql import EDGES, PART_EDGES, SEEDS, with_
from rillgraph.sources import graph as S
from rillgraph.sources import snapshots

NAMES_SQL = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.RELATION_NAMES.items()) + " ELSE relation END"


@query(with_(EDGES) + f"SELECT {NAMES_SQL} AS name, count(*) AS n FROM edges GROUP BY 1")
def relation_names(spark, sf):
    return S.edges(spark, sf).groupBy(X.relation_name(F.col("relation")).alias("name")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_size % 3 = 0 THEN '声音' WHEN p_size % 3 = 1 THEN '红色' ELSE p_type END || p_partkey AS label, CASE WHEN p_size % 3 = 0 THEN 'percept:auditory:声音' WHEN p_size % 3 = 1 THEN 'percept:visual:红色' ELSE 'percept:visual:' || p_type END || p_partkey AS percept FROM part")
def percept_guess(spark, sf):
    word = F.when(F.col("p_size") % 3 == 0, "声音").when(F.col("p_size") % 3 == 1, "红色").otherwise(F.col("p_type"))
    label = F.concat(word, F.col("p_partkey").cast("string"))
    return S.table(spark, sf, "part").select(label.alias("label"), X.percept_of(label).alias("percept"))


PRESET_SQL = ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in P.PRESETS)


@query(f"SELECT * FROM (VALUES {PRESET_SQL}) t(label, channel, threshold)")
def percept_presets(spark, sf):
    return P.presets(spark)


@query("SELECT DISTINCT 'percept:' || event_type || ':' || (user_id % 9) AS label, CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'visual' END AS channel, user_id % 2 = 0 AS valid FROM events")
def percept_custom(spark, sf):
    """Nodes named with or without their prefix; half of them under a channel that is not theirs."""
    u = F.col("user_id")
    bare = F.concat("event_type", F.lit(":"), (u % 9).cast("string"))
    label = F.when(u % 3 == 0, F.concat(F.lit("percept:"), bare)).otherwise(bare)
    rows = S.table(spark, sf, "events").select(label.alias("label"), F.when(u % 2 == 0, F.col("event_type")).otherwise("visual").alias("channel"))
    return P.custom_nodes(rows).distinct()


@query("""
WITH o AS (SELECT 'm' || (user_id % 50) AS label, event_type AS metric, sum(value::DECIMAL(28,9))::DOUBLE AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
n AS (SELECT 'm' || (user_id % 60) AS label, event_type AS metric, sum(value::DECIMAL(28,9))::DOUBLE AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(o.label, n.label) AS label, coalesce(o.metric, n.metric) AS metric, coalesce(a, 0) + coalesce(b, 0) AS value FROM o FULL JOIN n ON o.label = n.label AND o.metric = n.metric""")
def metric_increment(spark, sf):
    def of(odd, groups):
        rows = S.table(spark, sf, "events").filter(F.col("event_id") % 2 == odd)
        return rows.select(F.concat(F.lit("m"), (F.col("user_id") % groups).cast("string")).alias("label"), F.col("event_type").alias("metric"), "value")

    old = of(0, 50).groupBy("label", "metric").agg(F.sum(F.col("value").cast("decimal(28,9)")).cast("double").alias("value"))
    return X.merged_metrics(old, of(1, 60), add=True)


@query("SELECT goal_id, entry_id FROM (SELECT 'g' || (user_id % 30) AS goal_id, event_id AS entry_id, row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20")
def execution_log(spark, sf):
    rows = S.table(spark, sf, "events").select(F.concat(F.lit("g"), (F.col("user_id") % 30).cast("string")).alias("goal_id"), F.col("ts").alias("at"), F.col("event_id").alias("entry_id"), F.col("props").alias("entry"))
    return X.appended_log(rows.filter("entry_id % 2 = 0"), rows.filter("entry_id % 2 = 1")).select("goal_id", "entry_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS lang, c_mktsegment AS segment, (CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 2 END)::INT AS n FROM customer")
def preferences_merge(spark, sf):
    old = F.create_map(F.lit("lang"), F.lit("old"), F.lit("segment"), F.col("c_mktsegment"))
    new = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("lang"), F.lit("new"), F.lit("style"), F.lit("short")))
    both = S.table(spark, sf, "customer").select("c_custkey", X.merged_preferences(old, new).alias("m"))
    return both.select("c_custkey", F.col("m")["lang"].alias("lang"), F.col("m")["segment"].alias("segment"), F.size("m").alias("n"))


@query("""
WITH u AS (SELECT 'u' || user_id AS user_label, max(ts) AS last FROM events GROUP BY 1)
SELECT c_custkey AS goal_id, CASE WHEN c_custkey % 4 <> 0 AND (last IS NULL OR floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(last))) / 60) >= 10080) THEN 'archived' WHEN c_custkey % 4 = 0 THEN 'completed' ELSE 'pending' END AS status
FROM customer LEFT JOIN u ON user_label = 'u' || c_custkey""")
def goals_absent(spark, sf):
    """Goals of users who were away for a week."""
    c = F.col("c_custkey")
    goals = S.table(spark, sf, "customer").select(c.alias("goal_id"), F.concat(F.lit("u"), c.cast("string")).alias("user_label"), F.when(c % 4 == 0, "completed").otherwise("pending").alias("status"))
    users = S.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_label"), F.col("ts").alias("last_active"))
    return X.archive_absent(goals, users, F.lit("2024-02-01").cast("timestamp_ntz"), 10_080).select("goal_id", "status")


@query("SELECT event_id AS goal_id, CASE event_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN event_id % 5 = 0 THEN 0.1::DOUBLE ELSE value END AS weight, CASE WHEN event_id % 5 < 2 THEN TIMESTAMP '2024-02-01' ELSE ts END AS touched FROM events")
def goal_outcomes(spark, sf):
    i = F.col("event_id")
    e = S.table(spark, sf, "events")
    goals = e.select(i.alias("goal_id"), F.lit("pending").alias("status"), F.col("value").alias("weight"), F.col("ts").alias("touched"))
    outcomes = e.filter(i % 5 < 2).select(i.alias("goal_id"), F.when(i % 5 == 0, "completed").otherwise("failed").alias("status"))
    return X.explored(goals, outcomes, F.lit("2024-02-01").cast("timestamp_ntz"))


@query("""
WITH t AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem WHERE l_linenumber <> 7 AND l_discount * 10 >= 0.5::DOUBLE)
SELECT source, target, 'IS_A' AS relation, 0.8::DOUBLE AS weight FROM t""")
def import_taxonomy(spark, sf):
    """Triples with a confidence become edges."""
    relation = F.when(F.col("l_linenumber") == 7, "SYNONYM").otherwise("IS_A")
    t = S.table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"), relation.alias("relation"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("o"), (F.col("l_discount") * 10).alias("c"))
    return X.taxonomy_triples(t)[1]


@query("SELECT p_brand AS label, min(p_partkey) AS id FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size <= 2) GROUP BY 1 UNION ALL SELECT p_brand, min(p_partkey) FROM part WHERE p_size <= 2 GROUP BY 1")
def insert_ignore(spark, sf):
    """Insert or ignore: the first of a key wins, keys that are there stay."""
    part = S.table(spark, sf, "part")
    old = part.filter("p_size <= 2").groupBy(F.col("p_brand").alias("label")).agg(F.min("p_partkey").alias("id"))
    return G.insert_new(old, part.select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("id")), ["label"], ["id"])


@query(with_(SEEDS, PART_EDGES, BLANKED) + """,
up AS (SELECT b.label, min(p.domain) AS d FROM blanked b JOIN part_edges e ON e.source = b.label AND relation = 'IS_A' JOIN blanked p ON p.label = e.target WHERE coalesce(b.domain, '') = '' AND p.domain <> '' GROUP BY 1)
SELECT b.label, coalesce(nullif(b.domain, ''), d, '常识') AS domain FROM blanked b LEFT JOIN up USING (label)""")
def domain_backfill(spark, sf):
    nodes = S.seeds(spark, sf).withColumn("domain", F.when(F.col("label").startswith("part:"), "").otherwise(F.col("domain")))
    return X.backfilled(nodes, G.infer_domains(nodes, S.part_edges(spark, sf))).select("label", "domain")


@query(with_(PART_EDGES) + "SELECT source, target, relation, weight FROM part_edges")
def snapshot_roundtrip(spark, sf):
    """A version of the edges, written once and read back."""
    from rillgraph.session import fresh_path

    folder = fresh_path(spark, "snapshots")
    snapshots.write_snapshot(S.part_edges(spark, sf), folder, 1)
    return snapshots.read_snapshot(spark, folder, 1)


@query("""SELECT item_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM benchmark""")
def escaped_texts(spark, sf):
    return S.table(spark, sf, "benchmark").select("item_id", html_escaped(F.col("text")).alias("html"))


@query("""
WITH w AS (SELECT event_type, value, unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 4 MINUTES, time_bucket(INTERVAL 1 MINUTE, ts), INTERVAL 1 MINUTE)) AS start FROM events)
SELECT event_type, start, count(*) AS n, (list(value ORDER BY value))[ceil(0.99::DOUBLE * count(*))::INT] AS p99 FROM w GROUP BY 1, 2""")
def rolling_counts(spark, sf):
    """Events per type and their 99th percentile over 5 minutes that slide by one; the stream's query, over a table. So few values are exact."""
    from rillgraph.streaming.binding import rolling_rates

    return rolling_rates(S.table(spark, sf, "events"))


@query()
def visual_activation(spark, sf):
    """Grey frames of 8 pixels a row, one pixel per component of an embedding, scaled; the last row is filled with black."""
    bytes_ = F.expr("unhex(rpad(array_join(transform(embedding, x -> repeat(lpad(hex(cast(least(greatest((coalesce(x, 0) + 3) * 42, 0), 255) as bigint)), 2, '0'), 3)), ''), cast(ceil(size(embedding) / 8) as int) * 48, '0'))")
    frames = S.table(spark, sf, "embeddings").filter("size(embedding) > 0").select(F.col("vec_id").alias("frame_id"), F.lit(8).alias("width"), F.ceil(F.size("embedding") / 8).cast("int").alias("height"), bytes_.alias("rgb"))
    return P.visual(E.visual_features(frames))
