"""Queries over learning, monitoring, goals, tuning and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgraph.functions.columns import cycles_since, exact_sum
from rillgraph.operators import events as E
from rillgraph.operators import learning as L
from rillgraph.operators import meta as M
from rillgraph.operators import ripple as R
from rillgraph.plans.graph_queries import query
from rillgraph.plans.sql import EDGES, HISTORY, MATCHED, PART_EDGES, PERSONAL, SEEDS, exact, ripple, with_
from rillgraph.session import written
from rillgraph.sources import graph as S

# ---- paths, weights, pool


def _paths(spark, sf, asked=None, edges=None):
    """Learning paths of all queries, or of those asked (query_id); queries do not meet, so one's paths do not depend on others."""
    matched = S.matched(spark, sf)
    if asked is not None:
        matched = matched.join(asked, "query_id", "left_semi")
    return R.learned(matched, S.part_edges(spark, sf) if edges is None else edges)


LEARN = """
kept AS (SELECT query_id, source, target, min({'d': depth, 'r': relation}) AS m FROM paths GROUP BY 1, 2, 3),
learn AS MATERIALIZED (SELECT query_id, source, target, m.r AS relation FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m.d, source, target) AS n FROM kept) WHERE n <= 500)"""


@query(with_(PART_EDGES, MATCHED, ripple(2), LEARN) + "SELECT query_id, source, target, relation FROM learn")
def karma_paths(spark, sf):
    return _paths(spark, sf).select("query_id", "source", "target", "relation")


VERDICTS = """
verdicts AS (SELECT o_orderkey AS query_id, CASE WHEN o_totalprice > 200000 THEN 1 WHEN o_totalprice < 50000 THEN -1 ELSE 0 END AS direction, 'user:' || o_custkey AS user_label FROM orders),
deltas AS MATERIALIZED (SELECT l.*, direction * 0.01::DOUBLE AS delta, user_label FROM learn l JOIN verdicts USING (query_id) WHERE direction <> 0)"""


def _deltas(spark, sf):
    o = S.table(spark, sf, "orders")
    v = o.select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_totalprice") > 200000, 1).when(F.col("o_totalprice") < 50000, -1).otherwise(0).alias("direction"))
    return L.path_deltas(_paths(spark, sf), v), o.select(F.col("o_orderkey").alias("query_id"), S.key("user", "o_custkey").alias("user_label"))


@query(with_(PART_EDGES, MATCHED, ripple(2), LEARN, VERDICTS) + """,
d AS (SELECT source, target, relation, sum(round(delta, 9)::DECIMAL(28,9))::DOUBLE AS d FROM deltas GROUP BY 1, 2, 3)
SELECT e.source, e.target, e.relation, round(CASE WHEN d IS NULL THEN weight ELSE greatest(0.01::DOUBLE, least(2.0::DOUBLE, round(weight + d, 9))) END, 6) AS weight FROM part_edges e LEFT JOIN d USING (source, target, relation)""")
def karma_update(spark, sf):
    return L.adjust(S.part_edges(spark, sf), _deltas(spark, sf)[0]).withColumn("weight", F.round("weight", 6))


@query(with_(PART_EDGES, MATCHED, ripple(2), LEARN, VERDICTS, PERSONAL) + """,
d AS (SELECT user_label, source, target, relation, sum(round(delta, 9)::DECIMAL(28,9))::DOUBLE AS d FROM deltas GROUP BY ALL)
SELECT coalesce(p.user_label, d.user_label) AS user_label, coalesce(p.source, d.source) AS source, coalesce(p.target, d.target) AS target, coalesce(p.relation, d.relation) AS relation,
       round(CASE WHEN d IS NULL THEN weight ELSE greatest(0.01::DOUBLE, least(2.0::DOUBLE, round(coalesce(weight, 0.5) + d.d, 9))) END, 6) AS weight
FROM personal p FULL JOIN d ON p.user_label = d.user_label AND p.source = d.source AND p.target = d.target AND p.relation = d.relation""")
def personal_update(spark, sf):
    deltas, users = _deltas(spark, sf)
    own = S.personal(spark, sf)
    return L.adjust(own, deltas.join(users, "query_id"), key=["user_label", *L.EDGE]).withColumn("weight", F.round("weight", 6))


POOL = """
submitted AS (SELECT user_label, source, target, relation FROM deltas WHERE delta > 0),
canon AS (SELECT user_label, relation, CASE WHEN relation = 'COOCCURS_WITH' THEN least(source, target) ELSE source END AS source, CASE WHEN relation = 'COOCCURS_WITH' THEN greatest(source, target) ELSE target END AS target FROM submitted),
pool AS MATERIALIZED (SELECT source, target, relation, count(*) AS count, string_agg(DISTINCT user_label, ',' ORDER BY user_label) AS contributors, CASE WHEN count(*) >= 3 THEN 'upgraded' ELSE 'pending' END AS status FROM canon GROUP BY 1, 2, 3)"""


def _submitted(spark, sf, edges):
    """query_id, user_label and edge of each learning path of a reinforced query."""
    good = S.table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("query_id"), S.key("user", "o_custkey").alias("user_label"))
    return _paths(spark, sf, good.select("query_id"), edges).join(good, "query_id").select("query_id", "user_label", *L.EDGE)


def _pool(spark, sf, edges=None):
    """The pool of positive feedback."""
    return L.pool(_submitted(spark, sf, edges))


BASE = (PART_EDGES, MATCHED, ripple(2), LEARN, VERDICTS, POOL)


@query(with_(*BASE) + "SELECT * FROM pool")
def pool_rebuild(spark, sf):
    return _pool(spark, sf).withColumn("contributors", F.array_join("contributors", ","))


@query(with_(*BASE) + """
SELECT coalesce(e.source, p.source) AS source, coalesce(e.target, p.target) AS target, coalesce(e.relation, p.relation) AS relation, CASE WHEN p.source IS NULL THEN weight ELSE greatest(coalesce(weight, 0), 0.05::DOUBLE) END AS weight
FROM part_edges e FULL JOIN (SELECT * FROM pool WHERE status = 'upgraded') p ON e.source = p.source AND e.target = p.target AND e.relation = p.relation""")
def pool_upgrade(spark, sf):
    edges = written(S.part_edges(spark, sf), "part-edges")
    return L.upgrade(edges, _pool(spark, sf, edges))


@query(with_(PART_EDGES, MATCHED, ripple(2), LEARN, VERDICTS, recursive=True) + """,
sub AS MATERIALIZED (SELECT query_id AS asked, user_label, source, target, relation FROM deltas WHERE delta > 0),
cand AS MATERIALIZED (SELECT source, target, relation, row_number() OVER (ORDER BY min(asked), source, target, relation) AS i FROM sub GROUP BY source, target, relation),
near AS MATERIALIZED (SELECT source AS x, target AS n FROM part_edges UNION SELECT target, source FROM part_edges),
size AS (SELECT x, count(*) AS n FROM near GROUP BY x),
common AS (SELECT a.x AS a, b.x AS b, count(*) AS k FROM near a JOIN near b ON a.n = b.n GROUP BY a.x, b.x),
sim AS MATERIALIZED (SELECT a, b, k, s.n + t.n - k AS u FROM common JOIN size s ON s.x = a JOIN size t ON t.x = b WHERE 10 * k > 4 * (s.n + t.n - k)),
link AS MATERIALIZED (
  SELECT DISTINCT c.i, d.i AS j FROM cand c JOIN sim s ON s.a = c.source JOIN sim t ON t.a = c.target JOIN cand d ON d.source = s.b AND d.target = t.b AND d.i < c.i WHERE 10 * s.k * t.k > 4 * s.u * t.u),
linked AS MATERIALIZED (SELECT i, list(j) AS js, row_number() OVER (ORDER BY i) AS place FROM (SELECT i, j FROM link UNION SELECT j, NULL FROM link) GROUP BY i),
run AS (
  SELECT 0::BIGINT AS place, []::BIGINT[] AS led UNION ALL
  SELECT l.place, CASE WHEN list_has_any(run.led, l.js) THEN run.led ELSE list_append(run.led, l.i) END FROM run JOIN linked l ON l.place = run.place + 1),
led AS (SELECT unnest(led) AS i FROM (SELECT led FROM run ORDER BY place DESC LIMIT 1)),
joins AS (SELECT link.i, min(j) AS j FROM link JOIN led ON led.i = j WHERE link.i NOT IN (SELECT i FROM led) GROUP BY link.i),
final AS (SELECT c.*, coalesce(j, c.i) AS leader FROM cand c LEFT JOIN joins USING (i))
SELECT l.source, l.target, l.relation, count(*) AS count, string_agg(DISTINCT user_label, ',' ORDER BY user_label) AS contributors, count(DISTINCT f.i) AS merged, CASE WHEN count(*) >= 3 THEN 'upgraded' ELSE 'pending' END AS status
FROM sub s JOIN final f ON f.source = s.source AND f.target = s.target AND f.relation = s.relation JOIN cand l ON l.i = f.leader GROUP BY 1, 2, 3""")
def pool_merged(spark, sf):
    """The pool with equivalent candidates merged into the earliest."""
    from rillgraph.operators import equivalence

    edges = written(S.part_edges(spark, sf), "part-edges")
    rows = _submitted(spark, sf, edges).withColumnRenamed("query_id", "at")
    return equivalence.merged_pool(rows, edges).withColumn("contributors", F.array_join("contributors", ","))


@query(with_(SEEDS, *BASE) + """
SELECT DISTINCT source, target, relation, count FROM pool WHERE status = 'pending' AND (source IN (SELECT label FROM seeds WHERE domain = 'ECONOMY') OR target IN (SELECT label FROM seeds WHERE domain = 'ECONOMY'))""")
def pool_by_domain(spark, sf):
    return L.pool_in_domain(_pool(spark, sf), S.seeds(spark, sf), "ECONOMY")


@query(with_(*BASE) + """
SELECT p.source, p.target, p.relation, p.count - CASE WHEN e.source IS NULL THEN 0 ELSE 1 END AS count, CASE WHEN e.source IS NOT NULL AND p.count - 1 < 3 THEN 'cooled' ELSE status END AS status
FROM pool p LEFT JOIN (SELECT * FROM part_edges WHERE weight < 0.5) e ON e.source = p.source AND e.target = p.target AND e.relation = p.relation""")
def cooldown(spark, sf):
    edges = written(S.part_edges(spark, sf), "part-edges")
    _, cooled = L.cleanup(edges, _pool(spark, sf, edges), 0.5)
    return cooled.select("source", "target", "relation", "count", "status")


@query(with_(PART_EDGES) + """
SELECT source, target, relation, CASE WHEN relation = 'COOCCURS_WITH' AND source < target THEN weight ELSE weight + 0.1 END::DOUBLE AS weight FROM part_edges WHERE NOT (relation = 'IS_A' AND source LIKE '%7')""")
def rollback_single(spark, sf):
    old = S.part_edges(spark, sf)
    listed = old.filter("(relation = 'COOCCURS_WITH' and source < target) or (relation = 'IS_A' and source like '%7')")
    snapshot = old.filter("not (relation = 'IS_A' and source like '%7')")
    return L.rollback(old.withColumn("weight", F.col("weight") + 0.1), snapshot, listed)


# ---- aliases, candidates, users

ALIAS = """
ev AS (SELECT 'k' || (user_id % 40) AS keyword, CASE WHEN event_type <> 'error' THEN CASE WHEN value > 150 THEN event_type ELSE 'main' END END AS seed FROM events),
total AS (SELECT keyword, count(*) AS total_count FROM ev GROUP BY 1),
refs AS (SELECT keyword, seed, count(*) AS ref_count FROM ev WHERE seed IS NOT NULL GROUP BY 1, 2),
stats AS (SELECT keyword, coalesce(seed, '__none__') AS seed, coalesce(ref_count, 0) AS ref_count, total_count, coalesce(ref_count, 0)::DOUBLE / total_count AS rate FROM total LEFT JOIN refs USING (keyword))"""


def _alias(spark, sf):
    seed = F.when(F.col("event_type") != "error", F.when(F.col("value") > 150, F.col("event_type")).otherwise("main"))
    return L.alias_stats(S.table(spark, sf, "events").select(F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("keyword"), seed.alias("seed")))


@query("WITH " + ALIAS + " SELECT keyword, seed, ref_count, total_count, round(rate, 6) AS rate FROM stats")
def alias_stats(spark, sf):
    return _alias(spark, sf).withColumn("rate", F.round("rate", 6))


@query("WITH " + ALIAS + """,
r AS (SELECT *, row_number() OVER w AS rn, first_value(rate) OVER w AS one, nth_value(rate, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS two FROM stats WINDOW w AS (PARTITION BY keyword ORDER BY rate DESC, seed))
SELECT keyword, seed, CASE WHEN total_count < 5 OR seed = '__none__' THEN 'few' WHEN rate < 0.6::DOUBLE THEN 'low' WHEN keyword = 'k7' THEN 'already'
  WHEN coalesce(abs(rate - CASE WHEN rn = 1 THEN two ELSE one END) < 0.2::DOUBLE, false) THEN 'conflict' ELSE 'aliased' END AS decision FROM r""")
def alias_decision(spark, sf):
    known = spark.createDataFrame([("k7",)], "alias string")
    return L.alias_decisions(_alias(spark, sf), known).select("keyword", "seed", "decision")


@query(r"""
WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS label FROM conversations),
c AS (SELECT label, count(*) AS count, min(conv_id) AS since, max(conv_id) AS last FROM w GROUP BY 1 HAVING count(*) >= 5)
SELECT label, count, TIMESTAMP '2024-01-01' + to_days(since::INT) AS candidate_since, TIMESTAMP '2024-01-01' + to_days(last::INT) AS last_seen FROM c WHERE label NOT IN (SELECT unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) FROM benchmark)""")
def candidate_count(spark, sf):
    return _candidates(spark, sf)


def _candidates(spark, sf):
    base = F.lit("2024-01-01").cast("timestamp_ntz")
    turns = S.table(spark, sf, "conversations")
    seen = turns.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}{4,}"), F.lit(0))).alias("label"), (base + F.make_dt_interval(F.col("conv_id").cast("int"))).alias("seen_at"))
    known = S.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}{4,}"), F.lit(0))).alias("label")).distinct()
    return L.candidates(seen, known)


@query(with_(SEEDS) + """,
links AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
n AS (SELECT 'supplier:' || l_suppkey AS label, domain, count(*) AS n, min(l_partkey) AS pos FROM links JOIN seeds ON seeds.label = 'part:' || l_partkey WHERE domain <> '' GROUP BY 1, 2)
SELECT label, domain FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, pos) AS rn FROM n) WHERE rn = 1""")
def candidate_promote(spark, sf):
    """The domain of promoted nodes: that of most of the nodes they occur with."""
    links = S.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    named = links.withColumn("p", S.key("part", "l_partkey")).join(S.seeds(spark, sf).select(F.col("label").alias("p"), "domain"), "p")
    return L.majority_domain(named.select(S.key("supplier", "l_suppkey").alias("label"), "domain", F.col("l_partkey").alias("pos")))


@query(with_(PART_EDGES) + """,
p AS (SELECT 'part:' || a.l_partkey AS s, 'part:' || b.l_partkey AS t FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)
SELECT DISTINCT source, target, 'RELATED' AS relation, 0.05::DOUBLE AS weight FROM (SELECT s AS source, t AS target FROM p UNION ALL SELECT t, s FROM p)""")
def promotion_edges(spark, sf):
    items = S.ordered(S.table(spark, sf, "lineitem"))
    pairs = items.join(items.select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey").filter("l_partkey < b")
    promoted = pairs.groupBy(S.key("part", "l_partkey").alias("label")).agg(F.collect_set(S.key("part", "b")).alias("seeds"))
    return L.promotion_edges(promoted, S.part_edges(spark, sf)).select("source", "target", "relation", "weight")


@query(r"""
WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS label FROM conversations),
c AS (SELECT label, count(*) AS count, TIMESTAMP '2024-01-01' + to_days(min(conv_id)::INT) AS s, TIMESTAMP '2024-01-01' + to_days(max(conv_id)::INT) AS l FROM w GROUP BY 1 HAVING count(*) >= 5)
SELECT label, CASE WHEN s < TIMESTAMP '2024-04-10' - INTERVAL 90 DAYS THEN 'purge' WHEN l < TIMESTAMP '2024-04-10' - INTERVAL 30 DAYS THEN 'expire' ELSE 'keep' END AS action FROM c WHERE label NOT IN (SELECT unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) FROM benchmark)""")
def candidate_expire(spark, sf):
    rows = _candidates(spark, sf).withColumn("promoted_at", F.lit(None).cast("timestamp_ntz"))
    return L.expiry(rows, F.lit("2024-04-10").cast("timestamp_ntz")).select("label", "action")


@query(r"""
WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS word FROM benchmark),
w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS label FROM conversations),
c AS (SELECT label, count(*) AS count FROM w WHERE label NOT IN (SELECT word FROM k) GROUP BY 1 HAVING count(*) >= 5),
links AS (SELECT c.label, o.label AS seed, row_number() OVER (PARTITION BY c.label ORDER BY o.label) AS pos FROM (SELECT DISTINCT c.label, o.label AS seed FROM c JOIN w x ON x.label = c.label JOIN w o ON o.conv_id = x.conv_id AND o.turn = x.turn JOIN k ON k.word = o.label) c JOIN (SELECT DISTINCT label FROM w) o ON o.label = c.seed),
due AS (SELECT label FROM c WHERE count >= 10),
d AS (SELECT label, 'd' || (ascii(seed) % 4) AS domain, count(*) AS n, min(pos) AS pos FROM links GROUP BY 1, 2),
dom AS (SELECT label, domain FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, pos) AS rn FROM d) WHERE rn = 1)
SELECT 'candidate' AS part, label, CASE WHEN count >= 10 THEN 'promoted' ELSE 'candidate' END AS value FROM c
UNION ALL SELECT 'node', label, coalesce(domain, '未分类') FROM due LEFT JOIN dom USING (label)
UNION ALL SELECT 'edge', label, seed FROM links JOIN due USING (label) UNION ALL SELECT 'edge', seed, label FROM links JOIN due USING (label)""")
def candidate_promotion(spark, sf):
    """Words seen ten times become nodes with the domain of the known words in their turns, and are linked with these."""
    words = lambda df, *keep: df.select(*keep, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}{4,}"), F.lit(0))).alias("label"))
    turns = words(S.table(spark, sf, "conversations"), "conv_id", "turn")
    known = words(S.table(spark, sf, "benchmark")).distinct().select("label", F.concat(F.lit("d"), (F.ascii("label") % 4).cast("string")).alias("domain"))
    found = _candidates(spark, sf).select("label", "count")
    near = turns.join(known.select("label"), "label", "left_semi").select("conv_id", "turn", F.col("label").alias("seed")).distinct()
    links = turns.join(found.select("label"), "label", "left_semi").distinct().join(near, ["conv_id", "turn"]).groupBy("label").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))
    rows = found.join(links, "label", "left").select("label", "count", F.lit("candidate").alias("status"), F.lit(None).cast("timestamp_ntz").alias("promoted_at"), "seeds")
    edges = spark.createDataFrame([], "source string, target string, relation string, weight double")
    after, nodes, new = L.promote(rows, known, edges, F.lit("2024-04-10").cast("timestamp_ntz"))
    out = after.select(F.lit("candidate").alias("part"), "label", F.col("status").alias("value"))
    return out.unionByName(nodes.select(F.lit("node").alias("part"), "label", F.col("domain").alias("value"))).unionByName(new.select(F.lit("edge").alias("part"), F.col("source").alias("label"), F.col("target").alias("value")))


@query("SELECT o_custkey, count(*) AS queries, least(count(*) / 20.0::DOUBLE, 1.0::DOUBLE) AS factor FROM orders GROUP BY 1")
def cold_start(spark, sf):
    from rillgraph.functions.columns import cold_factor

    n = S.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("queries"))
    return n.withColumn("factor", cold_factor(F.col("queries")))


@query(with_(PERSONAL) + "SELECT user_label, count(*) AS edges FROM personal WHERE user_label <> 'user:1' GROUP BY 1")
def user_erase(spark, sf):
    left, _ = L.erase_user(S.personal(spark, sf), spark.createDataFrame([], "contributors array<string>"), "user:1")
    return left.groupBy("user_label").agg(F.count("*").alias("edges"))


@query("SELECT r_name AS domain, CASE r_regionkey WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.4 ELSE 0.7 END::DOUBLE AS score FROM region")
def reliability(spark, sf):
    store = S.table(spark, sf, "region").select(F.col("r_name").alias("domain"), F.when(F.col("r_regionkey") == 1, 1.5).when(F.col("r_regionkey") == 2, -1.0).when(F.col("r_regionkey") == 3, 0.4).alias("score")).filter("score is not null")
    return L.reliability(S.table(spark, sf, "region").select(F.col("r_name").alias("domain")), store)


# ---- metrics, monitors, goals, tuning


def _history(spark, sf):
    h = S.history(spark, sf)
    return h.withColumn("domains", F.when(F.col("user_id") % 5 == 0, F.array("domain", F.lit("shared"))).otherwise(F.array("domain")))


HIST2 = HISTORY + ", h2 AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN [domain, 'shared'] ELSE [domain] END AS domains FROM history)"


@query("WITH " + HIST2 + ", l AS (SELECT * FROM h2 ORDER BY created_at DESC, query_id DESC LIMIT 1000) SELECT domain, round(count(*)::DOUBLE / (SELECT count(*) FROM l), 6) AS share FROM (SELECT unnest(domains) AS domain FROM l) GROUP BY 1")
def selection_share(spark, sf):
    return M.selection_share(_history(spark, sf))


@query("WITH " + HIST2 + ", l AS (SELECT * FROM h2 ORDER BY created_at DESC, query_id DESC LIMIT 100), x AS (SELECT unnest(domains) AS domain, confidence FROM l) SELECT domain, round(count(*) FILTER (confidence < 0.3::DOUBLE)::DOUBLE / count(*), 6) AS rate, count(*) AS queries FROM x GROUP BY 1 HAVING round(count(*) FILTER (confidence < 0.3::DOUBLE)::DOUBLE / count(*), 6) > 0.3::DOUBLE")
def low_conf_domains(spark, sf):
    return M.low_confidence(_history(spark, sf))


@query("WITH " + HISTORY + f", m AS (SELECT 'queries' AS metric, count(*)::DOUBLE AS value, count(*) FILTER (created_at < TIMESTAMP '2024-01-15')::DOUBLE AS old FROM history UNION ALL SELECT 'confidence', round({exact('confidence')} / count(*), 4), round(sum(round(confidence, 9)::DECIMAL(28,9)) FILTER (created_at < TIMESTAMP '2024-01-15')::DOUBLE / count(*) FILTER (created_at < TIMESTAMP '2024-01-15'), 4) FROM history) SELECT metric, value, round(value - old, 4) AS change FROM m")
def system_metrics(spark, sf):
    def of(h):
        one = h.agg(F.count("*").cast("double").alias("queries"), F.round(exact_sum(F.col("confidence")) / F.count("*"), 4).alias("confidence"))
        return one.select(F.expr("stack(2, 'queries', queries, 'confidence', confidence) as (metric, value)"))

    h = S.history(spark, sf)
    return M.system_metrics(of(h), of(h.filter(F.col("created_at") < F.lit("2024-01-15").cast("timestamp_ntz")))).withColumn("change", F.round("change", 4))


MONITORS = """
monitors AS (
  SELECT DISTINCT 'meta:domain:' || domain AS label, 'domain' AS category, domain AS source_domain FROM seeds WHERE domain <> ''
  UNION SELECT DISTINCT 'meta:relation:' || relation, 'relation', '' FROM part_edges
  UNION SELECT 'meta:system_' || x, 'system', 'system_' || x FROM (VALUES ('total_nodes'), ('total_edges'), ('avg_confidence'), ('distillation_rate'), ('seed_growth_rate')) t(x))"""


@query(with_(SEEDS, PART_EDGES, MONITORS) + "SELECT * FROM monitors WHERE label <> 'meta:domain:geo'")
def meta_generate(spark, sf):
    return M.monitors(S.seeds(spark, sf), S.part_edges(spark, sf), spark.createDataFrame([("meta:domain:geo",)], "label string"))


@query(with_(SEEDS, PART_EDGES, MONITORS) + """,
m AS (SELECT label, category, length(label) % 7 - 3 AS change FROM monitors)
SELECT a.label AS source, b.label AS target, sum((sign(a.change) * 0.05::DOUBLE)::DECIMAL(28,9))::DOUBLE AS delta FROM m a JOIN m b ON a.category = b.category AND a.label <> b.label WHERE abs(a.change) >= 2 GROUP BY 1, 2""")
def meta_edges(spark, sf):
    m = M.monitors(S.seeds(spark, sf), S.part_edges(spark, sf), spark.createDataFrame([], "label string"))
    return M.monitor_edges(m.select("label", "category", F.lit("length").alias("metric"), (F.length("label") % 7 - 3).alias("change")))


@query("""
WITH s AS (SELECT event_id AS label, CASE event_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'dormant' ELSE 'retired' END AS status, (event_id * 37) % 400 AS unchanged, event_id % 4 = 0 AS changed FROM events),
n AS (SELECT *, CASE WHEN status = 'retired' THEN unchanged WHEN changed THEN 0 ELSE unchanged + 1 END AS n FROM s)
SELECT label, CASE WHEN status = 'active' AND n >= 100 AND NOT changed THEN 'dormant' WHEN status = 'dormant' AND changed THEN 'active' WHEN status = 'dormant' AND n >= 300 THEN 'retired' ELSE status END AS status, n::BIGINT AS unchanged FROM n""")
def dormancy(spark, sf):
    e = F.col("event_id")
    s = S.table(spark, sf, "events").select(e.alias("label"), F.when(e % 3 == 0, "active").when(e % 3 == 1, "dormant").otherwise("retired").alias("status"), (e * 37 % 400).alias("unchanged"), (e % 4 == 0).alias("changed"))
    return M.dormancy(s)


TRIGGERS = HISTORY + """,
t AS (SELECT domain, count(*) FILTER (confidence < 0.3::DOUBLE) AS low_count, count(*) FILTER (k > 90) AS conflicts, count(*)::DOUBLE AS density FROM history GROUP BY 1),
g AS (SELECT *, (SELECT sum(density) / count(*) FROM t) AS avg_density FROM t)"""


def _triggers(spark, sf):
    t = S.history(spark, sf).groupBy("domain").agg(F.count_if(F.col("confidence") < 0.3).alias("low_count"), F.count_if(F.col("k") > 90).alias("conflicts"), F.count("*").cast("double").alias("density"))
    return t.crossJoin(F.broadcast(t.agg((F.sum("density") / F.count("*")).alias("avg_density"))))  # one row


@query("WITH " + TRIGGERS + """,
k AS (SELECT domain, 'low_confidence' AS kind FROM g WHERE low_count > 5 UNION ALL SELECT domain, 'low_density' FROM g WHERE density < avg_density * 0.5::DOUBLE UNION ALL SELECT domain, 'high_conflict' FROM g WHERE conflicts > 10)
SELECT 'goal_' || substr(md5(domain || '|' || kind || '|2024-02-01'), 1, 6) AS goal_id, domain, kind FROM k""")
def goals_generate(spark, sf):
    return M.goals(_triggers(spark, sf), F.lit("2024-02-01"))


@query("WITH " + TRIGGERS + """
SELECT domain, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE * (low_count / density) + 0.3::DOUBLE * (density / (avg_density * 2)) + 0.2::DOUBLE * (conflicts / density) + 0.1::DOUBLE * 0.5::DOUBLE)) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS priority FROM g""")
def goal_priority(spark, sf):
    t = _triggers(spark, sf)
    return t.select("domain", M.priority(F.col("low_count") / F.col("density"), F.col("density") / (F.col("avg_density") * 2), F.col("conflicts") / F.col("density"), F.lit(0.5)).alias("priority"))


GOALS = """
goals AS (SELECT 'g' || event_id AS goal_id, ts AS touched, least(1.0::DOUBLE, value / 200) AS weight, 'pending' AS status FROM events)"""


def _goals(spark, sf):
    e = S.table(spark, sf, "events")
    return e.select(F.concat(F.lit("g"), F.col("event_id").cast("string")).alias("goal_id"), F.col("ts").alias("touched"), F.least(F.lit(1.0), F.col("value") / 200).alias("weight"), F.lit("pending").alias("status"))


@query("WITH " + GOALS + """,
c AS (SELECT goal_id, status, weight, CASE WHEN floor((epoch(TIMESTAMP '2024-01-20') - floor(epoch(touched))) / 60) >= 10 THEN floor(weight * 0.8::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END AS cooled FROM goals)
SELECT goal_id, CASE WHEN cooled < 0.05::DOUBLE THEN 'expired' ELSE status END AS status, coalesce(cooled, weight) AS weight FROM c""")
def goals_cool(spark, sf):
    return M.cool(_goals(spark, sf), F.lit("2024-01-20").cast("timestamp_ntz"))


@query("WITH " + GOALS + " SELECT goal_id, weight FROM (SELECT * FROM goals ORDER BY weight DESC, touched DESC, goal_id LIMIT 3) WHERE weight > 0.6::DOUBLE")
def goal_schedule(spark, sf):
    return M.schedule(_goals(spark, sf)).select("goal_id", "weight")


@query("WITH " + GOALS + " SELECT goal_id FROM goals ORDER BY weight DESC, touched DESC, goal_id LIMIT 1000")
def goal_evict(spark, sf):
    return M.evict(_goals(spark, sf)).select("goal_id")


@query("WITH " + GOALS + " SELECT status, weight >= 0.5::DOUBLE AS high, count(*) AS n FROM goals GROUP BY 1, 2")
def goal_stats(spark, sf):
    return _goals(spark, sf).groupBy("status", (F.col("weight") >= 0.5).alias("high")).agg(F.count("*").alias("n"))


GRID = HISTORY + """,
grid AS (SELECT i / 100 AS threshold FROM range(20, 81, 5) r(i)),
c AS (SELECT threshold, count(*) FILTER (confidence >= threshold AND direction > 0) AS tp, count(*) FILTER (confidence >= threshold AND direction <= 0) AS fp, count(*) FILTER (confidence < threshold AND direction > 0) AS fn FROM history, grid GROUP BY 1),
f AS (SELECT *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c)"""


@query("WITH " + GRID + " SELECT * FROM f")
def tune_threshold(spark, sf):
    return M.threshold_grid(S.history(spark, sf))


@query("WITH " + GRID + " SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def tune_pick(spark, sf):
    return M.pick_best(M.threshold_grid(S.history(spark, sf)), "threshold", "f1")


@query("WITH " + HISTORY + " SELECT domain, round(count(*) FILTER (direction > 0)::DOUBLE / count(*), 6) AS positive, round(count(*) FILTER (direction < 0)::DOUBLE / count(*), 6) AS negative, round(2 * count(*) FILTER (direction > 0)::DOUBLE / nullif(2 * count(*) FILTER (direction > 0) + count(*) FILTER (direction < 0), 0), 6) AS quality FROM history GROUP BY 1")
def tune_karma(spark, sf):
    p, n = F.count_if(F.col("direction") > 0), F.count_if(F.col("direction") < 0)
    return S.history(spark, sf).groupBy("domain").agg(F.round(p / F.count("*"), 6).alias("positive"), F.round(n / F.count("*"), 6).alias("negative"), F.round(2 * p / F.nullif(2 * p + n, F.lit(0)), 6).alias("quality"))


@query("WITH " + HISTORY + """,
stats AS (SELECT 0.5::DOUBLE + (user_id % 3) / 10 AS decay_factor, (user_id % 4)::DOUBLE AS depth, (query_id % 50)::DOUBLE AS n FROM history),
grid AS (SELECT i / 100 AS decay FROM range(50, 111, 5) r(i)),
near AS (SELECT decay, count(*) FILTER (abs(decay_factor - decay) <= 0.1::DOUBLE + 1e-9) AS near FROM grid, stats GROUP BY 1),
eff AS (SELECT decay, count(*) FILTER (n > 0) AS used, coalesce(sum(round(depth / sqrt(nullif(n, 0)), 9)::DECIMAL(28,9)) FILTER (n > 0), 0)::DOUBLE AS total FROM near JOIN stats ON near = 0 OR abs(decay_factor - decay) <= 0.1::DOUBLE + 1e-9 GROUP BY 1)
SELECT decay, CASE WHEN used = 0 OR total = 0 THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - abs(1 - 0.7::DOUBLE / decay) / (0.7::DOUBLE / decay))), 6) END AS precision FROM eff""")
def tune_decay(spark, sf):
    """Decay precision of a grid over logged rows."""
    h = S.history(spark, sf)
    stats = h.select((F.lit(0.5) + (F.col("user_id") % 3) / 10).alias("decay_factor"), (F.col("user_id") % 4).cast("double").alias("ripple_depth"), (F.col("query_id") % 50).cast("double").alias("activated_count"))
    return M.decay_grid(stats, [i / 100 for i in range(50, 111, 5)])


@query("WITH " + HISTORY + """,
g AS (SELECT i / 100 AS threshold, count(*) FILTER (confidence >= i / 100) AS p, count(*) FILTER (confidence < i / 100 AND confidence < 0.3::DOUBLE) AS n, count(*) AS total FROM history, range(50, 96, 5) r(i) GROUP BY 1)
SELECT threshold, round(p::DOUBLE / total, 6) AS positive, round(n::DOUBLE / total, 6) AS negative, round(coalesce(2 * p::DOUBLE / nullif(2 * p + n, 0), 0), 6) AS quality FROM g""")
def tune_quality(spark, sf):
    return M.quality_grid(S.history(spark, sf), [i / 100 for i in range(50, 96, 5)])


@query(with_(EDGES, HISTORY) + """
SELECT 'weight' AS kind, source || '|' || target || '|' || relation AS subject, weight + 1.2::DOUBLE AS value FROM edges WHERE weight + 1.2::DOUBLE > 1.8::DOUBLE
UNION ALL SELECT 'conflict', domain, count(*) FILTER (k > 90)::DOUBLE FROM history GROUP BY domain HAVING count(*) FILTER (k > 90) > 10
UNION ALL SELECT 'channel', domain, count(*)::DOUBLE FROM history WHERE created_at >= (SELECT max(created_at) FROM history) - INTERVAL 5 MINUTES GROUP BY domain HAVING count(*) > 5""")
def alerts(spark, sf):
    h = S.history(spark, sf)
    h = h.crossJoin(F.broadcast(h.agg(F.max("created_at").alias("last"))))  # one row
    e = S.edges(spark, sf).withColumn("weight", F.col("weight") + 1.2)
    return M.alerts(e, h.withColumn("conflict", F.coalesce(F.col("k") > 90, F.lit(False))), F.col("last"))


@query("WITH " + HISTORY + " SELECT query_id, domain, confidence FROM history ORDER BY created_at DESC, query_id DESC LIMIT 20 OFFSET 40")
def history_page(spark, sf):
    return S.history(spark, sf).orderBy(F.desc("created_at"), F.desc("query_id")).offset(40).limit(20).select("query_id", "domain", "confidence")


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 AND event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'")
def audit_filter(spark, sf):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return S.table(spark, sf, "events").filter((F.col("user_id") == 7) & (F.col("event_type") == "error") & (F.col("ts") >= at("2024-01-05")) & (F.col("ts") < at("2024-01-25"))).select("event_id", "user_id", "event_type")


@query("SELECT user_id, (list(event_type ORDER BY ts DESC, event_id DESC))[1] AS last_type FROM events GROUP BY 1")
def last_status(spark, sf):
    return S.table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("SELECT event_id AS id, ts AS created_at, row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 30 AS kept FROM events")
def checkpoint_retention(spark, sf):
    rows = S.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return M.newest(rows, 30)


# ---- events


def _sides(spark, sf):
    e = S.table(spark, sf, "events")
    side = lambda f, seed: e.filter(f).select("event_id", seed.alias("seed"), "ts")
    return side("event_type in ('view', 'click')", F.concat(F.lit("percept:"), "event_type", F.lit(":"), (F.col("user_id") % 5).cast("string"))), side("event_type = 'purchase'", F.concat(F.lit("c:"), (F.col("user_id") % 7).cast("string")))


NEAR = """
p AS (SELECT event_id AS percept_id, 'percept:' || event_type || ':' || (user_id % 5) AS percept, epoch_us(ts) // 1000 AS t1 FROM events WHERE event_type IN ('view', 'click')),
c AS (SELECT event_id AS concept_id, 'c:' || (user_id % 7) AS concept, epoch_us(ts) // 1000 AS t2 FROM events WHERE event_type = 'purchase'),
near AS (SELECT percept_id, concept_id, percept, concept, abs(t1 - t2) AS apart_ms FROM p JOIN c ON t1 - t2 BETWEEN -60000 AND 60000),
bind AS (SELECT percept, concept, count(*) AS n, greatest(0.01::DOUBLE, least(2.0::DOUBLE, round(count(*) * 0.01::DOUBLE, 9))) AS weight FROM near GROUP BY 1, 2)"""


def _near(spark, sf):
    return E.co_activations(*_sides(spark, sf), window_ms=60_000)


@query("WITH " + NEAR + " SELECT percept_id, concept_id, percept, concept, apart_ms::BIGINT AS apart_ms FROM near")
def hebbian_pairs(spark, sf):
    return _near(spark, sf)


@query("WITH " + NEAR + " SELECT * FROM bind")
def hebbian_weights(spark, sf):
    return E.bindings(_near(spark, sf))


@query("WITH " + NEAR + ", seen AS (SELECT DISTINCT percept FROM bind WHERE n >= 6), d AS (SELECT percept, concept, n, CASE WHEN percept IN (SELECT percept FROM seen) THEN weight ELSE round(weight - 0.001::DOUBLE, 9) END AS weight FROM bind) SELECT * FROM d WHERE weight >= 0.01::DOUBLE")
def hebbian_decay(spark, sf):
    b = E.bindings(_near(spark, sf))
    return E.decay(b, b.filter("n >= 6"))


@query("WITH " + NEAR + " SELECT split_part(percept, ':', 2) AS channel, count(*) AS bindings, sum(n)::BIGINT AS sightings FROM bind GROUP BY 1")
def binding_status(spark, sf):
    return E.bindings(_near(spark, sf)).groupBy(F.element_at(F.split("percept", ":"), 2).alias("channel")).agg(F.count("*").alias("bindings"), F.sum("n").alias("sightings"))


@query("SELECT event_type AS seed, (list(value ORDER BY ts DESC, event_id DESC))[1] AS activation, max(ts) AS last_activation, count(*) AS activation_count FROM events GROUP BY 1")
def percept_state(spark, sf):
    return E.percept_state(S.table(spark, sf, "events").withColumnRenamed("event_type", "seed"))


@query("SELECT user_id AS key, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, greatest(count(*) - 2, 0) AS blocked FROM events GROUP BY 1, 2")
def rate_limit_windows(spark, sf):
    return E.rate_windows(S.table(spark, sf, "events").withColumnRenamed("user_id", "key"), 2, "1 day")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT user_id, event_id, i, ts AS start, 1 AS n FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.i, CASE WHEN epoch_us(e.ts) - epoch_us(r.start) > 86400000000 THEN e.ts ELSE r.start END, CASE WHEN epoch_us(e.ts) - epoch_us(r.start) > 86400000000 THEN 1 ELSE r.n + 1 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, n <= 2 AS allowed FROM r""")
def rate_limit_fixed(spark, sf):
    return E.fixed_windows(S.table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", "event_id"), 2, 86_400)


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, value > 60 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT user_id, event_id, i, 'closed' AS state, true AS passed, CASE WHEN failed THEN 1 ELSE 0 END AS bad, CASE WHEN failed THEN ts END AS last, false AS is_open FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, CASE WHEN shut THEN 'open' ELSE 'closed' END, NOT shut, CASE WHEN shut THEN bad ELSE now END, CASE WHEN failed AND NOT shut THEN ts ELSE last END, shut OR (failed AND now >= 3)
  FROM (SELECT *, CASE WHEN failed THEN (CASE WHEN is_open THEN 0 ELSE bad END) + 1 ELSE 0 END AS now
        FROM (SELECT e.user_id, e.event_id, e.i, e.ts, e.failed, r.bad, r.last, r.is_open, r.is_open AND epoch_us(e.ts) - epoch_us(r.last) <= 86400000000 AS shut
              FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
SELECT event_id, state, passed FROM r""")
def circuit_breaker(spark, sf):
    calls = S.table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), "ts", (F.col("value") > 60).alias("failed"))
    return E.circuit_breaker(calls, 3, 86_400)


@query()
def audio_features(spark, sf):
    frames = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").cast("array<double>").alias("samples"))
    return E.audio_features(frames)


@query("""
WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t FROM events)
SELECT p.event_id AS percept_id, c.event_id AS concept_id, p.event_type AS percept, c.event_type AS concept FROM e p JOIN e c ON p.t - c.t BETWEEN -60000000 AND 60000000 WHERE p.event_type IN ('view', 'click') AND c.event_type = 'purchase'""")
def stream_hebbian(spark, sf):
    """Stream-stream co-activation over the events folder, run to its end."""
    from rillgraph.session import fresh_path
    from rillgraph.streaming import binding as B

    folder = fresh_path(spark, "stream")
    S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/in")
    stream = lambda f: B.events(spark, f"{folder}/in", 8).filter(f).select("event_id", F.col("event_type").alias("seed"), "ts")
    return B.run_to_end(B.co_activations(stream("event_type in ('view', 'click')"), stream("event_type = 'purchase'"), 60_000, "40 days"), folder)


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
k AS (SELECT id, other, round(c, 6) AS similarity FROM s WHERE c > 0.3::DOUBLE)
SELECT id, count(*) AS n, (list(other ORDER BY similarity DESC, other))[1] AS best, max(similarity) AS similarity FROM k GROUP BY 1""")
def align_candidates(spark, sf):
    """Alignment candidates of every vector among those of its class, by cosine: how many, and the nearest."""
    from rillgraph.operators import perception as P

    return P.aligned(S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x")))


@query("""
WITH e AS (SELECT event_id AS frame_id, value / 3 AS t, value / 4 AS m, value * 2 AS d FROM events),
a AS (
  SELECT frame_id, 'percept:somatic:high_temp' AS seed, (t - 70) / 30 AS x FROM e WHERE t BETWEEN 0 AND 150 AND t > 70
  UNION ALL SELECT frame_id, 'percept:somatic:low_temp', (50 - t) / 20 FROM e WHERE t BETWEEN 0 AND 150 AND t < 50
  UNION ALL SELECT frame_id, 'percept:somatic:high_memory', (m - 80) / 20 FROM e WHERE m BETWEEN 0 AND 100 AND m > 80
  UNION ALL SELECT frame_id, 'percept:somatic:low_memory', (50 - m) / 30 FROM e WHERE m BETWEEN 0 AND 100 AND m < 50
  UNION ALL SELECT frame_id, 'percept:somatic:slow_response', (d - 300) / 300 FROM e WHERE d > 300)
SELECT frame_id, seed, least(1.0::DOUBLE, x) AS activation FROM a""")
def somatic_activation(spark, sf):
    from rillgraph.operators import perception as P

    v = F.col("value")
    f = S.table(spark, sf, "events").select(F.col("event_id").alias("frame_id"), (v / 3).alias("cpu_temp"), (v / 4).alias("memory_percent"), (v * 2).alias("latency_ms"))
    return P.somatic(f)


@query()
def auditory_activation(spark, sf):
    from rillgraph.operators import perception as P

    frames = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").cast("array<double>").alias("samples"))
    return P.auditory(E.audio_features(frames))


@query("SELECT p_type AS domain, CASE WHEN count(*) > 0 AND p_type <> 'ECONOMY' THEN 'internal' WHEN max(p_size) > 10 THEN 'candidate_upgrade' ELSE 'none' END AS strategy FROM part GROUP BY 1")
def explore_strategy(spark, sf):
    from rillgraph.operators import perception as P

    counts = S.table(spark, sf, "part").groupBy(F.col("p_type").alias("domain")).agg(F.count("*").alias("seeds"), F.max("p_size").alias("big"))
    return P.strategy(counts.select("domain", "seeds", F.when(F.col("domain") != "ECONOMY", 1).otherwise(0).alias("edges"), F.when(F.col("big") > 10, 1).otherwise(0).alias("pending")))


# ---- extensions: what the driver's tables make useful beyond the reference


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (1, 2)".replace("(1, 2)", "(o_orderpriority, o_orderstatus)"))
def ext_cube(spark, sf):
    return S.table(spark, sf, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def ext_rollup(spark, sf):
    return S.table(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""
WITH g AS (SELECT user_id AS key, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT key, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS "end", count(*) AS n FROM s GROUP BY key, i""")
def ext_session_window(spark, sf):
    return E.sessions(S.table(spark, sf, "events").withColumnRenamed("user_id", "key"), "1 day")


@query("""
SELECT l.event_id AS id, (SELECT r.value FROM events r WHERE r.user_id = l.user_id AND r.event_type = 'view' AND r.ts <= l.ts ORDER BY r.ts DESC, r.value DESC LIMIT 1) AS value FROM events l WHERE l.event_type = 'purchase'""")
def ext_asof(spark, sf):
    e = S.table(spark, sf, "events").withColumnRenamed("user_id", "key")
    return E.as_of_join(e.filter("event_type = 'purchase'").select("key", "ts", F.col("event_id").alias("id")), e.filter("event_type = 'view'").select("key", "ts", "value"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def ext_intersect_except(spark, sf):
    t = lambda n, c: S.table(spark, sf, n).select(F.col(c).alias("k"))
    return t("customer", "c_nationkey").intersect(t("supplier", "s_nationkey")).subtract(S.table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("k")))


@query()
def ext_approx_distinct(spark, sf):
    return S.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))
