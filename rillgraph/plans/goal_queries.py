"""A cycle over goals: its SQL is written from the rules, step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgraph.functions.columns import exact_sum
from rillgraph.operators import goals as G
from rillgraph.operators import graph
from rillgraph.plans.graph_queries import query
from rillgraph.plans.sql import PART_EDGES, exact, with_
from rillgraph.sources import graph as S

#: Goals that the pool of the query holds.
ROOM = 200

CYCLE = """
nodes AS (SELECT 'part:' || p_partkey AS label, p_type || '/' || p_brand AS domain, p_partkey, p_size FROM part),
own AS MATERIALIZED (SELECT domain, e.* FROM part_edges e JOIN nodes ON label = source),
mean AS (SELECT """ + exact("weight") + """ / count(*) AS density FROM own),
mon AS (SELECT domain, CASE WHEN domain LIKE '%5' THEN 'dormant' ELSE 'active' END AS status, count(*) FILTER (p_size > 40)::DOUBLE AS conflicts, coalesce((SELECT round(""" + exact("weight") + """ / count(*), 6) FROM own WHERE own.domain = nodes.domain AND relation = 'COOCCURS_WITH'), 0) AS density FROM nodes GROUP BY domain),
asks AS (
  SELECT domain, 'low_confidence' AS kind, 0 AS late, 0 AS rank, NULL AS user_label FROM mon WHERE status = 'active' AND conflicts > 5
  UNION ALL SELECT domain, 'low_density', 0, 1, NULL FROM mon, mean WHERE status = 'active' AND mon.density < mean.density * 0.5::DOUBLE
  UNION ALL SELECT domain, 'high_conflict', 0, 2, NULL FROM mon WHERE status = 'active' AND conflicts > 10
  UNION ALL SELECT domain, 'new_term', 1, 3, 'user:' || count(*) FROM nodes WHERE p_size <= 30 GROUP BY domain HAVING count(*) > 5),
core AS (SELECT domain FROM nodes GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 1),
near AS (SELECT DISTINCT own.domain FROM own JOIN nodes n ON n.label = own.target JOIN core ON core.domain = n.domain WHERE own.domain <> core.domain),
prio AS (
  SELECT n.domain, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE * floor(least(1.0::DOUBLE, count(*) FILTER (p_partkey % 14 < 7 AND label IN (SELECT source FROM own WHERE relation = 'IS_A'))::DOUBLE / count(*)) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE
      + 0.3::DOUBLE * CASE WHEN n.domain IN (SELECT domain FROM core) THEN 1.0::DOUBLE WHEN n.domain IN (SELECT domain FROM near) THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END
      + 0.2::DOUBLE * floor(least(1.0::DOUBLE, max(conflicts) / 10) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE
      + 0.1::DOUBLE * floor(least(1.0::DOUBLE, count(*) FILTER (label IN (SELECT source FROM own))::DOUBLE / 5) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE)) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS weight
  FROM nodes n JOIN mon USING (domain) GROUP BY n.domain),
had AS (
  SELECT 'had:' || domain || kind AS goal_id, domain, kind, CASE WHEN domain LIKE '%1%' THEN 'completed' WHEN domain LIKE 'M%' THEN 'exploring' ELSE 'pending' END AS status, length(domain) / 40.0::DOUBLE AS weight, CASE WHEN domain LIKE '%2' THEN 'user:gone' END AS user_label, 25 AS age
  FROM (SELECT DISTINCT domain FROM nodes), (VALUES ('low_density'), ('new_term')) k(kind) WHERE domain NOT LIKE '%3'),
op AS (SELECT * FROM had WHERE status IN ('pending', 'exploring')),
after AS (
  SELECT goal_id, domain, kind, status, weight, user_label, age FROM had WHERE status NOT IN ('pending', 'exploring')
  UNION ALL SELECT op.goal_id, op.domain, op.kind, op.status, CASE WHEN a.kind IS NULL THEN op.weight ELSE p.weight END, op.user_label, CASE WHEN a.kind IS NULL THEN age ELSE 0 END FROM op LEFT JOIN asks a USING (domain, kind) LEFT JOIN prio p ON p.domain = op.domain
  UNION ALL SELECT 'goal_' || substr(md5(domain || '|' || kind || '|2024-02-01 00:00:00'), 1, 6), domain, kind, 'pending', weight, user_label, 0
  FROM (SELECT a.*, p.weight, row_number() OVER (ORDER BY late, a.domain, rank) AS place FROM asks a JOIN prio p USING (domain) WHERE NOT EXISTS (SELECT 1 FROM op WHERE op.domain = a.domain AND op.kind = a.kind)) WHERE place <= {room} - (SELECT count(*) FROM op)),
dec AS (SELECT *, CASE WHEN status = 'pending' AND age >= 10 THEN floor(weight * 0.8::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END AS c FROM after),
d2 AS (SELECT *, CASE WHEN c < 0.05::DOUBLE THEN 'expired' ELSE status END AS s2 FROM dec),
d3 AS (SELECT *, s2 = 'pending' AND user_label IS NOT NULL AND user_label NOT IN (SELECT 'user:' || p_size FROM part WHERE p_size < 20) AS away FROM d2),
d4 AS (SELECT *, CASE WHEN away THEN 'archived' ELSE s2 END AS s3 FROM d3),
low AS (SELECT goal_id FROM (SELECT goal_id, row_number() OVER (ORDER BY coalesce(c, weight), age DESC, goal_id) AS place FROM d4 WHERE s3 = 'pending') WHERE place <= (SELECT count(*) FROM d4 WHERE s3 IN ('pending', 'exploring')) - {small})
SELECT goal_id, domain, kind, CASE WHEN low.goal_id IS NOT NULL THEN 'expired' ELSE s3 END AS status, coalesce(c, weight) AS weight, user_label, status AS old_status, CASE WHEN low.goal_id IS NOT NULL THEN 'pool_evict' WHEN away THEN 'user_absent' WHEN c < 0.05::DOUBLE THEN 'decay_expire' WHEN c IS NOT NULL THEN 'decay' END AS reason
FROM d4 LEFT JOIN low USING (goal_id)"""


@query(with_(PART_EDGES) + "," + CYCLE.replace("{room}", str(ROOM)).replace("{small}", str(ROOM - 60)))
def goal_cycle(spark, sf):
    """Triggers, priorities, admission to a pool that fills up, cooling, absent users and eviction, over domains of parts by type and brand."""
    part, at = S.table(spark, sf, "part"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    domain = F.concat_ws("/", "p_type", "p_brand")
    nodes = part.select(S.key("part", "p_partkey").alias("label"), F.lit("CONCEPT").alias("type"), domain.alias("domain"), "p_partkey", "p_size")
    edges = S.part_edges(spark, sf)
    own = nodes.select(F.col("label").alias("source"), "domain").join(edges, "source")
    mean = own.agg((exact_sum(F.col("weight")) / F.count("*")).alias("density"))
    density = own.filter("relation = 'COOCCURS_WITH'").groupBy("domain").agg(F.round(exact_sum(F.col("weight")) / F.count("*"), 6).alias("density"))
    monitors = nodes.groupBy("domain").agg(F.count_if(F.col("p_size") > 40).cast("double").alias("conflicts")).join(density, "domain", "left")
    monitors = monitors.select("domain", F.when(F.col("domain").endswith("5"), "dormant").otherwise("active").alias("status"), F.create_map(F.lit("conflict_frequency"), "conflicts", F.lit("avg_karma_density"), F.coalesce("density", F.lit(0.0))).alias("metrics"))
    terms = nodes.filter("p_size <= 30").groupBy("domain").agg(F.count("*").alias("n")).select("domain", F.lit("word").alias("word"), "n", F.concat(F.lit("user:"), F.col("n").cast("string")).alias("user_label"))
    asks = G.triggered(monitors.crossJoin(F.broadcast(mean)), F.col("density"), terms)  # one row of mean
    personal = edges.filter("relation = 'IS_A'").join(nodes.select(F.col("label").alias("source"), "p_partkey"), "source").select("source", (at - F.make_dt_interval(F.col("p_partkey").cast("int") % 14)).alias("updated_at"))
    core = nodes.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(1).select("domain")
    weights = G.priorities(asks, nodes, edges, personal, monitors, core, graph.domain_distance(nodes, edges, 1), at)
    kinds = F.explode(F.array(F.lit("low_density"), F.lit("new_term"))).alias("kind")
    had = nodes.select("domain").distinct().filter("domain not like '%3'").select("domain", kinds)
    status = F.when(F.col("domain").contains("1"), "completed").when(F.col("domain").startswith("M"), "exploring").otherwise("pending")
    old = at - F.expr("INTERVAL 25 MINUTES")
    had = had.select(
        F.concat(F.lit("had:"), "domain", "kind").alias("goal_id"), "domain", "kind", F.lit("old").alias("condition"), status.alias("status"), (F.length("domain") / 40.0).alias("weight"),
        F.when(F.col("domain").endswith("2"), "user:gone").alias("user_label"), old.alias("touched"), old.alias("created"),
    )
    after = G.admitted(had, asks, weights, at, ROOM)
    users = part.filter("p_size < 20").select(F.concat(F.lit("user:"), F.col("p_size").cast("string")).alias("user_label"), at.alias("seen"))
    return G.cooled(after, users, at, ROOM - 60).select("goal_id", "domain", "kind", "status", "weight", "user_label", "old_status", "reason")
