"""Queries over users, what they and outside sources give to the graph, and configured thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgraph.operators import learning as L
from rillgraph.operators import meta as M
from rillgraph.operators import perception as P
from rillgraph.operators import state as X
from rillgraph.operators import users as U
from rillgraph.operators import verify as V
from rillgraph.plans.graph_queries import query
from rillgraph.plans.sql import EDGES, HISTORY, PART_EDGES, SEEDS, exact, with_
from rillgraph.sources import graph as S


@query("""
WITH seen AS (SELECT DISTINCT lower(c_mktsegment) AS source, o_custkey AS id FROM orders JOIN customer ON c_custkey = o_custkey),
made AS (SELECT source, id, 'user_' || substr(sha256(source || ':' || id), 1, 8) AS user_id FROM seen),
kept AS (SELECT lower(c_mktsegment) AS source, c_custkey AS id, 'old:' || c_custkey AS user_id FROM customer WHERE c_nationkey < 8),
after AS (SELECT * FROM kept UNION ALL SELECT * FROM made m WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.source = m.source AND k.id = m.id)),
node AS (SELECT user_id, min(source) AS source FROM after WHERE user_id NOT LIKE 'old:%' GROUP BY 1)
SELECT a.user_id, a.source, a.id::VARCHAR AS source_id, n.user_id IS NOT NULL AS created, '来源:' || n.source AS definition FROM after a LEFT JOIN node n USING (user_id)""")
def user_resolve(spark, sf):
    """Every order is an arrival of its customer; those of the first eight nations have an id."""
    c = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lower("c_mktsegment").alias("source"), "c_nationkey")
    arrivals = S.table(spark, sf, "orders").join(c, "o_custkey").select("source", F.col("o_custkey").cast("string").alias("source_id"))
    old = c.filter("c_nationkey < 8").select("source", F.col("o_custkey").cast("string").alias("source_id"), F.concat(F.lit("old:"), F.col("o_custkey").cast("string")).alias("user_id"))
    mapping, nodes = U.resolved(old, arrivals)
    out = mapping.join(nodes.select(F.col("label").alias("user_id"), "definition"), "user_id", "left")
    return out.select("user_id", "source", "source_id", F.isnotnull("definition").alias("created"), "definition")


@query(with_(EDGES) + """,
given AS (SELECT 'user:' || user_id AS source, 'topic:' || event_type AS target, 'RELATED' AS relation, value / 100 AS weight, ts FROM events
  UNION ALL SELECT 'user:' || c_custkey, 'nation:' || (c_nationkey + c_custkey % 2), 'LOCATED_IN', 3.0::DOUBLE, NULL FROM customer),
one AS (SELECT source, target, relation, greatest(0.01::DOUBLE, least(2.0::DOUBLE, weight)) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY source, target, relation ORDER BY ts NULLS LAST, weight) AS rn FROM given) WHERE rn = 1)
SELECT * FROM edges UNION ALL SELECT * FROM one WHERE (source, target, relation) NOT IN (SELECT (source, target, relation) FROM edges)""")
def user_edges(spark, sf):
    """Users' edges to topics, the first of a pair by time; and to nations, where half of them are there and stay as they are."""
    e, c = S.table(spark, sf, "events"), S.table(spark, sf, "customer")
    topics = e.select(S.key("user", "user_id").alias("user_label"), F.concat(F.lit("topic:"), "event_type").alias("target"), F.lit("RELATED").alias("relation"), (F.col("value") / 100).alias("weight"), F.col("ts").alias("at"))
    nation = F.concat(F.lit("nation:"), (F.col("c_nationkey") + F.col("c_custkey") % 2).cast("string"))
    homes = c.select(S.key("user", "c_custkey").alias("user_label"), nation.alias("target"), F.lit("LOCATED_IN").alias("relation"), F.lit(3.0).alias("weight"), F.lit(None).cast("timestamp_ntz").alias("at"))
    return U.with_own_edges(S.edges(spark, sf), topics.unionByName(homes.withColumn("at", F.col("at").cast(topics.schema["at"].dataType))))


@query("""
WITH own AS (SELECT DISTINCT c_nationkey, l_partkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
n AS (SELECT n_nationkey, (SELECT count(*) FROM own WHERE c_nationkey = n_nationkey) AS edges, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey * 7 END AS counted FROM nation),
q AS (SELECT n_nationkey, coalesce(counted, edges // 500) AS queries, counted IS NULL AS estimated FROM n)
SELECT 'nation:' || n_nationkey AS user_label, queries, queries < 20 AS cold, least(queries / 20.0::DOUBLE, 1.0::DOUBLE) AS factor, estimated FROM q""")
def cold_recovery(spark, sf):
    """The cold start of nations as users; a third of them have lost their count and are estimated from their personal edges."""
    nation = S.table(spark, sf, "nation")
    lines = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    homes = S.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(S.table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    own = lines.join(homes, "o_orderkey").select(S.key("nation", "c_nationkey").alias("user_label"), "l_partkey", "l_suppkey").distinct()
    counted = nation.filter("n_nationkey % 3 <> 0").select(S.key("nation", "n_nationkey").alias("user_label"), (F.col("n_regionkey") * 7).alias("queries"))
    return U.cold_state(nation.select(S.key("nation", "n_nationkey").alias("user_label")), counted, own)


PENDING = PART_EDGES + """,
cand AS (SELECT 'part:' || a AS source, 'part:' || b AS target, 'COOCCURS_WITH' AS relation, n AS count, CASE WHEN n >= 3 THEN 'upgraded' ELSE 'pending' END AS status FROM together WHERE a < b)"""


def _pending(spark, sf):
    """Parts that orders share as candidates: those of two orders wait."""
    pairs = S.cooccurrence(S.table(spark, sf, "lineitem")).filter("a < b")
    return pairs.select(S.key("part", "a").alias("source"), S.key("part", "b").alias("target"), F.lit("COOCCURS_WITH").alias("relation"), F.col("n").alias("count"), F.when(F.col("n") >= 3, "upgraded").otherwise("pending").alias("status"))


@query(with_(PENDING) + """,
asked AS (SELECT DISTINCT CASE WHEN r_regionkey = 0 THEN 'PROMO' WHEN r_regionkey = 1 THEN 'L' ELSE r_name END AS word FROM region),
ends AS (SELECT source, target, p_type AS domain FROM cand JOIN part ON 'part:' || p_partkey IN (source, target) WHERE status = 'pending'),
held AS (SELECT DISTINCT word, domain FROM ends JOIN asked ON contains(domain, word)),
chosen AS (SELECT domain FROM held h WHERE domain = word OR NOT EXISTS (SELECT 1 FROM held x WHERE x.word = h.word AND x.domain = x.word)),
due AS (SELECT DISTINCT source, target FROM ends WHERE domain IN (SELECT domain FROM chosen)),
pool AS (SELECT c.source, c.target, c.relation, count, CASE WHEN d.source IS NOT NULL THEN 'upgraded' ELSE status END AS status FROM cand c LEFT JOIN due d ON c.source = d.source AND c.target = d.target),
known AS (SELECT * FROM part_edges WHERE relation = 'IS_A'),
up AS (SELECT source, target, 'COOCCURS_WITH' AS relation FROM due)
SELECT 'pool' AS part, source, target, relation, count::DOUBLE AS value, status FROM pool
UNION ALL SELECT 'edge', source, target, relation, weight, NULL FROM known UNION ALL SELECT 'edge', source, target, relation, 0.05::DOUBLE, NULL FROM up""")
def pool_domain_upgrade(spark, sf):
    """Waiting candidates of a domain by its name, and of domains that hold a word where none has its name, go to the graph, here of IS_A only."""
    asked = S.table(spark, sf, "region").select(F.when(F.col("r_regionkey") == 0, "PROMO").when(F.col("r_regionkey") == 1, "L").otherwise(F.col("r_name")).alias("domain"))
    edges, pool = L.upgrade_in_domains(S.part_edges(spark, sf).filter("relation = 'IS_A'"), _pending(spark, sf), S.seeds(spark, sf).filter("label like 'part:%'"), asked)
    out = pool.select(F.lit("pool").alias("part"), *L.EDGE, F.col("count").cast("double").alias("value"), "status")
    return out.unionByName(edges.select(F.lit("edge").alias("part"), *L.EDGE, F.col("weight").alias("value"), F.lit(None).cast("string").alias("status")))


@query("""
WITH old AS (SELECT 'part:' || p_partkey AS source, p_type AS target, 'DEFINED_AS' AS relation, 2 AS count, 'user:1' AS contributors, 'pending' AS status FROM part WHERE p_size <= 20
  UNION ALL SELECT 'part:' || p_partkey, 'brand:' || p_brand, 'IS_A', 3, 'user:1,user:2', 'upgraded' FROM part),
new AS (SELECT 'part:' || l_partkey AS source, p_type AS target, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount > 0.05 GROUP BY 1, 2)
SELECT coalesce(o.source, n.source) AS source, coalesce(o.target, n.target) AS target, coalesce(o.relation, 'DEFINED_AS') AS relation, coalesce(o.count, 0) + coalesce(n.n, 0) AS count, coalesce(contributors, 'system:curiosity') AS contributors, coalesce(status, 'pending') AS status
FROM old o FULL JOIN new n ON o.source = n.source AND o.target = n.target AND o.relation = 'DEFINED_AS'""")
def pool_external(spark, sf):
    """What an outside source says of parts, once for each line at a discount, over a pool that knows some of it."""
    part = S.table(spark, sf, "part")
    row = lambda target, relation, count, users, status: (S.key("part", "p_partkey").alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(count).cast("long").alias("count"), F.array(*map(F.lit, users)).alias("contributors"), F.lit(status).alias("status"))
    old = part.filter("p_size <= 20").select(*row(F.col("p_type"), "DEFINED_AS", 2, ["user:1"], "pending")).unionAll(part.select(*row(S.key("brand", "p_brand"), "IS_A", 3, ["user:1", "user:2"], "upgraded")))
    lines = S.table(spark, sf, "lineitem").filter("l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey"))
    found = lines.join(part.select("p_partkey", "p_type"), "p_partkey").select(S.key("part", "p_partkey").alias("label"), F.col("p_type").alias("domain"))
    return L.submit_external(old, found).withColumn("contributors", F.array_join("contributors", ","))


@query("""
WITH ev AS (SELECT 'k' || (l_partkey % 400) AS keyword, CASE WHEN l_linenumber < 7 THEN 'supplier:' || CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 12 ELSE l_suppkey % 10 END END AS seed FROM lineitem),
total AS (SELECT keyword, count(*) AS total_count FROM ev GROUP BY 1),
stats AS (SELECT keyword, seed, count(*)::DOUBLE / any_value(total_count) AS rate, any_value(total_count) AS n FROM ev JOIN total USING (keyword) WHERE seed IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS rn, first_value(rate) OVER w AS one, nth_value(rate, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS two FROM stats WINDOW w AS (PARTITION BY keyword ORDER BY rate DESC, seed)),
due AS (SELECT seed AS label, list(keyword ORDER BY keyword) AS more FROM r WHERE n >= 5 AND rate >= 0.6::DOUBLE AND keyword <> 'k7' AND NOT coalesce(abs(rate - CASE WHEN rn = 1 THEN two ELSE one END) < 0.2::DOUBLE, false) GROUP BY 1),
node AS (SELECT 'supplier:' || s_suppkey AS label, CASE WHEN s_suppkey % 2 = 0 THEN ['k3', s_name] ELSE [] END AS aliases FROM supplier)
SELECT label, array_to_string(aliases || list_filter(coalesce(more, []), lambda x: NOT list_contains(aliases, x)), ',') AS aliases, coalesce(len(more), 0) AS done FROM node LEFT JOIN due USING (label)""")
def alias_append(spark, sf):
    """Words that point to one supplier most of the time become its aliases."""
    part, seed = F.col("l_partkey"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 12).otherwise(F.col("l_suppkey") % 10)
    events = S.table(spark, sf, "lineitem").select(F.concat(F.lit("k"), (part % 400).cast("string")).alias("keyword"), F.when(F.col("l_linenumber") < 7, F.concat(F.lit("supplier:"), seed.cast("string"))).alias("seed"))
    decisions = L.alias_decisions(L.alias_stats(events), spark.createDataFrame([("k7",)], "alias string"))
    have = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("k3"), "s_name"))
    seeds, done = L.append_aliases(S.table(spark, sf, "supplier").select(S.key("supplier", "s_suppkey").alias("label"), have.alias("aliases")), decisions)
    n = done.groupBy(F.col("seed").alias("label")).agg(F.count("*").alias("done"))
    text = F.coalesce(F.array_join("aliases", ","), F.lit(""))
    return seeds.join(n, "label", "left").select("label", text.alias("aliases"), F.coalesce("done", F.lit(0)).alias("done"))


def _system_sql(at: str) -> str:
    day = f"created_at > TIMESTAMP '{at}' - INTERVAL 1 DAY AND created_at <= TIMESTAMP '{at}'"
    return f"""
SELECT 'system_total_nodes' AS metric, count(*)::DOUBLE AS value FROM dated WHERE created_at <= TIMESTAMP '{at}' UNION ALL SELECT 'system_seed_growth_rate', count(*)::DOUBLE FROM dated WHERE {day}
UNION ALL SELECT 'system_total_edges', count(*)::DOUBLE FROM part_edges
UNION ALL SELECT 'system_avg_confidence', coalesce(floor({exact('confidence')} / count(*) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE, 0) FROM history WHERE {day}
UNION ALL SELECT 'system_distillation_rate', (count(*) FILTER (direction <> 0))::DOUBLE FROM history WHERE {day}"""


@query(with_(SEEDS, PART_EDGES, HISTORY) + """,
dated AS (SELECT 'user:' || user_id AS label, min(ts) AS created_at FROM events GROUP BY 1 UNION ALL SELECT label, TIMESTAMP '2023-12-31' FROM seeds WHERE type <> 'USER'),
now AS (""" + _system_sql("2024-01-02") + "),\nold AS (" + _system_sql("2024-01-01 12:00:00") + ")\nSELECT metric, value, round(value - coalesce(o.old, 0), 4) AS change FROM now LEFT JOIN (SELECT metric, value AS old FROM old WHERE metric <> 'system_total_edges') o USING (metric)")
def system_monitors(spark, sf):
    """All five monitors of the system at a day's end against noon, where one had no value yet. Users come with their first event."""
    users = S.table(spark, sf, "events").groupBy(S.key("user", "user_id").alias("label")).agg(F.min("ts").alias("created_at")).withColumn("type", F.lit("USER"))
    others = S.seeds(spark, sf).filter("type <> 'USER'").select("label", F.lit("2023-12-31").cast(users.schema["created_at"].dataType).alias("created_at"), "type")
    nodes, edges, history = users.unionByName(others), S.part_edges(spark, sf), S.history(spark, sf)

    def at(time):
        t = F.lit(time).cast("timestamp_ntz")
        return M.system_values(nodes.filter(F.col("created_at") <= t), edges, history, t)

    before = at("2024-01-01 12:00:00").filter("metric <> 'system_total_edges'")
    return M.system_metrics(at("2024-01-02 00:00:00"), before).withColumn("change", F.round("change", 4))


def _rules_sql(features: str, rules: list[tuple[str, str, str]]) -> str:
    return f"WITH f AS ({features})" + " UNION ALL ".join(f" SELECT frame_id, 'percept:{seed}' AS seed, least(1.0::DOUBLE, ({value})::DOUBLE) AS activation FROM f WHERE {when}" for seed, when, value in rules)


@query(_rules_sql("SELECT event_id AS frame_id, value / 500 AS r, 1 - value / 500 AS g, (user_id % 11) / 10.0::DOUBLE AS b, (user_id % 7) / 6.0::DOUBLE AS l, (event_id % 13) / 12.0::DOUBLE AS e FROM events", [
    ("visual:red", "r > 0.3", "r"), ("visual:green", "g > 0.5", "g"), ("visual:blue", "b > 0.3", "b"), ("visual:bright", "l > 0.7", "l"), ("visual:dark", "l < 0.25", "1 - l"), ("visual:edge_dense", "e > 0.4", "e"),
]))
def visual_rules(spark, sf):
    """The rules of sight over given features. Two thresholds are configured, two more are out of bounds and do not count."""
    u, v = F.col("user_id"), F.col("value")
    f = S.table(spark, sf, "events").select(F.col("event_id").alias("frame_id"), (v / 500).alias("red"), (1 - v / 500).alias("green"), (u % 11 / 10).alias("blue"), (u % 7 / 6).alias("brightness"), (F.col("event_id") % 13 / 12).alias("edges"))
    return P.visual(f, {"green": 0.5, "dark": 0.25, "red": 1.5, "edge_dense": -0.1})


@query(_rules_sql("SELECT event_id AS frame_id, value * 3 AS f, value * 40 AS c, user_id % 4 = 0 AS p FROM events", [
    ("auditory:high_freq", "f > 600", "f / 1000"), ("auditory:low_freq", "f < 200 AND f > 0", "(200 - f) / 200"), ("auditory:bright_sound", "c > 3000", "c / 10000"), ("auditory:dark_sound", "c < 1500 AND c > 0", "c / 3000"), ("auditory:percussive", "p", "0.8"),
]))
def auditory_rules(spark, sf):
    """The rules of sound over given features. One threshold is configured, one is below 0 and does not count."""
    v = F.col("value")
    f = S.table(spark, sf, "events").select(F.col("event_id").alias("frame_id"), (v * 3).alias("dominant"), (v * 40).alias("centroid"), (F.col("user_id") % 4 == 0).alias("percussive"))
    return P.auditory(f, high=600.0, low=-1.0)


@query(r"""
WITH names AS (SELECT DISTINCT lower(source) AS word FROM documents WHERE source IS NOT NULL UNION SELECT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) FROM benchmark),
known AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS word FROM conversations),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS word FROM documents)
SELECT doc_id AS answer_id, count(*) AS n, count(k.word) AS n_known, min(w.word) AS first FROM w LEFT JOIN known k USING (word)
WHERE w.word NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'are', 'was') AND w.word NOT IN (SELECT word FROM names) GROUP BY 1""")
def keyword_names(spark, sf):
    """Keywords of texts but for the names of domains: here the sources and the words of the benchmark."""
    docs = S.table(spark, sf, "documents")
    words = lambda name: S.table(spark, sf, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}{2,}"), F.lit(0))).alias("word")).distinct()
    names = docs.select(F.col("source").alias("name")).filter("name is not null").union(words("benchmark"))
    found = V.answer_keywords(docs.select(F.col("doc_id").alias("answer_id"), "text"), words("conversations"), names)
    return found.groupBy("answer_id").agg(F.count("*").alias("n"), F.count_if("known").alias("n_known"), F.min("word").alias("first"))


@query("""
WITH t AS (SELECT 's' || l_suppkey AS s, CASE WHEN l_linenumber = 7 THEN 'SYNONYM' ELSE 'IS_A' END AS relation, 'p' || l_partkey AS o FROM lineitem WHERE l_discount * 10 >= 0.5::DOUBLE)
SELECT 'node' AS part, label, NULL AS aliases FROM (SELECT s AS label FROM t WHERE relation = 'IS_A' UNION SELECT o FROM t WHERE relation = 'IS_A')
UNION ALL SELECT 'alias', s, string_agg(DISTINCT o, ',' ORDER BY o) FROM t WHERE relation = 'SYNONYM' GROUP BY s""")
def import_taxonomy_nodes(spark, sf):
    """The nodes and aliases of the triples whose edges import_taxonomy gives."""
    key = lambda kind, column: F.concat(F.lit(kind), F.col(column).cast("string"))
    t = S.table(spark, sf, "lineitem").select(key("s", "l_suppkey").alias("s"), F.when(F.col("l_linenumber") == 7, "SYNONYM").otherwise("IS_A").alias("relation"), key("p", "l_partkey").alias("o"), (F.col("l_discount") * 10).alias("c"))
    nodes, _, aliases = X.taxonomy_triples(t)
    return nodes.select(F.lit("node").alias("part"), "label", F.lit(None).cast("string").alias("aliases")).unionByName(aliases.select(F.lit("alias").alias("part"), "label", F.array_join("aliases", ",").alias("aliases")))
