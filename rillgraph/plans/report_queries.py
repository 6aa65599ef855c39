"""Queries over imports, lists, sinks, pools, goals and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgraph.functions import text as T
from rillgraph.operators import imports as I
from rillgraph.operators import meta as M
from rillgraph.operators import reports as P
from rillgraph.operators import ripple as R
from rillgraph.plans.graph_queries import BLANKED, query
from rillgraph.plans.sql import EDGES, HISTORY, MATCHED, PART_EDGES, SEEDS, exact, ripple, with_
from rillgraph.session import dealt, fresh_path
from rillgraph.sources import graph as S
from rillgraph.sources import snapshots
from rillgraph.streaming import binding as B


@query(with_(PART_EDGES) + """,
k AS (SELECT 'part:' || p_partkey AS source, 'brand:' || p_brand AS target, CASE WHEN p_size % 2 = 0 THEN 'IS_A' ELSE 'HAS' END AS relation FROM part)
SELECT source, target, relation, weight FROM k LEFT JOIN part_edges USING (source, target, relation)""")
def edge_lookup(spark, sf):
    """Single edges by key; half of the keys are no edge."""
    keys = S.table(spark, sf, "part").select(S.key("part", "p_partkey").alias("source"), S.key("brand", "p_brand").alias("target"), F.when(F.col("p_size") % 2 == 0, "IS_A").otherwise("HAS").alias("relation"))
    return I.edges_of(keys, S.part_edges(spark, sf))


TRIPLES = """
triples AS (SELECT 'part:' || l_partkey AS s, CASE l_linenumber WHEN 1 THEN 'RELATED' WHEN 2 THEN 'CAUSE' WHEN 3 THEN 'PART_OF' ELSE 'OTHER' END AS relation, 'ship:' || l_returnflag AS o, 1 - l_discount * 5 AS c FROM lineitem),
layer AS (SELECT s AS source, o AS target, relation, max(CASE WHEN c >= .9 THEN .7 WHEN c >= .7 THEN .5 WHEN c >= .5 THEN .3 ELSE 0 END)::DOUBLE AS weight FROM triples WHERE relation <> 'OTHER' AND c >= .5 GROUP BY 1, 2, 3)"""


def _layer(spark, sf):
    n = F.col("l_linenumber")
    relation = F.when(n == 1, "RELATED").when(n == 2, "CAUSE").when(n == 3, "PART_OF").otherwise("OTHER")
    lines = S.table(spark, sf, "lineitem")
    t = lines.select(S.key("part", "l_partkey").alias("s"), relation.alias("relation"), S.key("ship", "l_returnflag").alias("o"), (1 - F.col("l_discount") * 5).alias("c"))
    return I.weighted_triples(dealt(t, lines.count(), "s", "relation", "o"), S.part_edges(spark, sf), S.seeds(spark, sf))


@query(with_(PART_EDGES, TRIPLES) + "SELECT * FROM layer l WHERE NOT EXISTS (SELECT 1 FROM part_edges e WHERE e.source = l.source AND e.target = l.target AND e.relation = l.relation)")
def import_layer2(spark, sf):
    """Triples of the second layer as new edges."""
    return _layer(spark, sf)[0]


@query(with_(SEEDS, TRIPLES) + "SELECT source AS label FROM layer WHERE source NOT IN (SELECT label FROM seeds) UNION SELECT target FROM layer WHERE target NOT IN (SELECT label FROM seeds)")
def import_endpoints(spark, sf):
    """Endpoints of the second layer that become nodes."""
    return _layer(spark, sf)[1]


@query("""
WITH a AS (SELECT trim(regexp_replace('*~ ' || p_name, '^[^\\p{L}\\p{N}_]+', '')) AS label, max(p_brand || ' ' || p_type) AS content FROM (SELECT p_name, p_brand, p_type, row_number() OVER (PARTITION BY p_name ORDER BY length(p_brand || ' ' || p_type) DESC, p_brand || ' ' || p_type DESC) AS rn FROM part) WHERE rn = 1 GROUP BY 1),
o AS (SELECT p_name AS label, max(CASE WHEN p_size % 2 = 0 THEN '' ELSE repeat('x', p_size) END) AS definition FROM part WHERE p_size <= 30 GROUP BY 1)
SELECT coalesce(o.label, a.label) AS label, CASE WHEN content IS NOT NULL AND length(coalesce(definition, '')) < length(content) THEN content ELSE coalesce(definition, '') END AS definition,
       CASE WHEN o.label IS NULL THEN 'dd_' || substr(md5(a.label), 1, 12) END AS id
FROM o FULL JOIN a ON o.label = a.label""")
def title_import(spark, sf):
    """Titles with marks before them and contents: shorter definitions are replaced, other titles inserted."""
    part = S.table(spark, sf, "part")
    articles = part.select(F.concat(F.lit("*~ "), "p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("content"))
    own = part.filter("p_size <= 30").groupBy(F.col("p_name").alias("label")).agg(F.max(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.expr("repeat('x', p_size)"))).alias("definition"))
    return I.titled(articles, own)


@query(with_(SEEDS, PART_EDGES, BLANKED) + """,
b AS (SELECT label, CASE WHEN label LIKE 'part:%' THEN '' ELSE domain END AS domain FROM blanked WHERE type <> 'USER'),
up AS (SELECT x.label, min(p.domain) AS d FROM b x JOIN part_edges e ON e.source = x.label AND relation = 'IS_A' JOIN b p ON p.label = e.target WHERE coalesce(x.domain, '') = '' AND p.domain <> '' GROUP BY 1),
w AS (SELECT label, CASE WHEN lower(definition) LIKE '%supplier#00000001%' THEN 'first' WHEN lower(definition) LIKE '%supplier%' THEN 'supply' END AS d FROM seeds)
SELECT b.label, coalesce(up.d, w.d, '常识') AS inferred, CASE WHEN up.d IS NOT NULL THEN 'is_a' WHEN w.d IS NOT NULL THEN 'dictionary' ELSE 'fallback' END AS method FROM b LEFT JOIN up USING (label) LEFT JOIN w USING (label) WHERE coalesce(b.domain, '') = ''""")
def domain_chain(spark, sf):
    """Domains by ancestors, then by words of the definition, then the default."""
    nodes = S.seeds(spark, sf).filter("type <> 'USER'").withColumn("domain", F.when(F.col("label").startswith("part:"), "").otherwise(F.col("domain")))
    words = spark.createDataFrame([("supplier", "supply"), ("supplier#00000001", "first")], "keyword string, domain string")
    return I.chained_domains(nodes, S.part_edges(spark, sf), (nodes.select(F.col("label").alias("id"), F.col("definition").alias("text")), words))


@query("SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,4}')) AS word FROM benchmark UNION ALL SELECT unnest(['the', 'und']))")
def stopword_file(spark, sf):
    """Stop words from a file beside the built-in ones."""
    folder = fresh_path(spark, "stopwords")
    words = S.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,4}"), F.lit(0))).alias("value")).distinct()
    words.unionAll(spark.createDataFrame([("# a comment",), ("  ",)], "value string")).write.text(folder)
    return snapshots.stopwords(spark, folder, ["the", "und"])


@query("SELECT p_partkey::VARCHAR AS word, p_name AS definition FROM part")
def dictionary_file(spark, sf):
    """A dictionary from JSON lines; lines that do not parse are left out."""
    folder = fresh_path(spark, "dictionary")
    rows = S.table(spark, sf, "part").select(F.to_json(F.struct(F.col("p_partkey").cast("string").alias("word"), F.col("p_name").alias("definition"))).alias("value"))
    rows.unionAll(spark.createDataFrame([("{broken",)], "value string")).write.text(folder)
    return snapshots.dictionary(spark, folder).select("word", "definition")


@query("SELECT vec_id AS id, embedding[-8:] AS tail FROM embeddings".replace("embedding[-8:] AS tail", "list_sum(list_transform(embedding[-8:], lambda x: round(x::DOUBLE, 6)::DECIMAL(18,6)))::DOUBLE AS tail"))
def embedding_tail(spark, sf):
    """The last components of each embedding, summed."""
    rows = snapshots.latest_embeddings(S.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), 8)
    return rows.select("id", F.aggregate(F.transform("embedding", lambda x: F.round(x.cast("double"), 6).cast("decimal(18,6)")), F.lit(0).cast("decimal(18,6)"), lambda s, x: (s + x).cast("decimal(18,6)")).cast("double").alias("tail"))


@query("SELECT conv_id, turn, substr(text, 1, 40) AS text FROM conversations")
def history_append(spark, sf):
    """A log that two runs append to, texts cut."""
    folder = fresh_path(spark, "history")
    rows = S.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    P.append(rows.filter("turn % 2 = 0"), folder, {"text": 40})
    P.append(rows.filter("turn % 2 = 1"), folder, {"text": 40})
    return spark.read.parquet(folder)


@query("WITH " + HISTORY + " SELECT query_id, domain FROM history ORDER BY created_at DESC, query_id DESC LIMIT 100 OFFSET 5")
def history_clamped(spark, sf):
    """A page asked for with 5,000 rows has 100."""
    return P.page(S.history(spark, sf), [F.desc("created_at"), F.desc("query_id")], 5000, 5).select("query_id", "domain")


@query("WITH " + HISTORY + " SELECT query_id, user_id FROM history WHERE domain = 'error' AND created_at >= TIMESTAMP '2024-01-10'")
def audit_query(spark, sf):
    """Predicates that may be left out: here the user and the end are."""
    at = F.lit("2024-01-10").cast("timestamp_ntz")
    return P.listed(S.history(spark, sf), since=("created_at", at), until=None, domain="error", user_id=None).select("query_id", "user_id")


@query(with_(PART_EDGES) + "SELECT source, target, weight FROM part_edges WHERE source LIKE 'part:1%' AND relation = 'IS_A'")
def list_bindings(spark, sf):
    """Edges by the prefix of their source and by relation."""
    return P.listed(S.part_edges(spark, sf), starts={"source": "part:1"}, relation="IS_A").select("source", "target", "weight")


@query("WITH w(word) AS (VALUES ('1_'), ('%'), ('a')) SELECT word, p_partkey FROM part JOIN w ON contains(p_name, word)")
def like_lookup(spark, sf):
    """Words with wildcards in them, as they are written."""
    words = spark.createDataFrame([("1_",), ("%",), ("a",)], "word string")
    return P.containing(S.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", words).select("word", "p_partkey")


@query(with_(SEEDS, PART_EDGES, MATCHED, ripple(2)) + f""",
scores AS (SELECT query_id, coalesce(nullif(domain, ''), '常识') AS domain, {exact('activation')} AS score FROM state2 LEFT JOIN seeds USING (label) GROUP BY 1, 2),
d AS (SELECT query_id, string_agg(domain, ',' ORDER BY score DESC, domain) AS selected_domains FROM scores WHERE score >= 0.3::DOUBLE GROUP BY 1),
s AS (SELECT query_id, max(depth)::BIGINT AS ripple_depth, count(*) AS activated_count FROM state2 GROUP BY 1)
SELECT s.*, selected_domains, o_shippriority * 0.5::DOUBLE + 0.4::DOUBLE AS confidence FROM s LEFT JOIN d USING (query_id) LEFT JOIN orders ON o_orderkey = query_id""".replace("o_shippriority * 0.5::DOUBLE + 0.4::DOUBLE", "CASE WHEN o_totalprice > 200000 THEN 0.9 ELSE 0.2 END::DOUBLE"))
def param_stats(spark, sf):
    """A log row per query: depth, activated nodes, selected domains, verdict."""
    run = R.ripple(S.matched(spark, sf), S.part_edges(spark, sf))
    verdicts = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_totalprice") > 200000, 0.9).otherwise(0.2).alias("confidence"), F.lit(0).alias("direction"))
    out = P.param_stats(run.activated, R.domain_scores(run.activated, S.seeds(spark, sf)), verdicts)
    return out.select("query_id", F.col("ripple_depth").cast("long").alias("ripple_depth"), "activated_count", "selected_domains", "confidence")


@query("WITH " + HISTORY + " SELECT query_id, domain FROM history ORDER BY created_at DESC, query_id DESC LIMIT 20")
def recent_queries(spark, sf):
    return P.recent(S.history(spark, sf)).select("query_id", "domain")


@query(with_(SEEDS, PART_EDGES) + "SELECT domain, count(*) FILTER (label IN (SELECT source FROM part_edges)) AS sources, count(*) AS nodes, round(least(1.0::DOUBLE, count(*) FILTER (label IN (SELECT source FROM part_edges))::DOUBLE / count(*)), 4) AS share FROM seeds WHERE type <> 'META' AND domain <> '' GROUP BY 1")
def domain_sources(spark, sf):
    return P.domain_sources(S.part_edges(spark, sf), S.seeds(spark, sf))


@query(with_(SEEDS) + "SELECT domain FROM seeds WHERE domain <> '' AND type <> 'META' GROUP BY 1 ORDER BY count(*) DESC, domain LIMIT 1")
def core_domain(spark, sf):
    return P.core_domain(S.seeds(spark, sf))


GOALS = """
goals AS (SELECT event_id AS goal_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'exploring' WHEN 2 THEN 'completed' ELSE 'expired' END AS status, event_type || (user_id % 50) AS domain, CASE WHEN event_id % 2 = 0 THEN 'low_density' ELSE 'new_term' END AS kind, least(1.0::DOUBLE, value / 200) AS weight, ts AS touched FROM events)"""


def _goals(spark, sf):
    i = F.col("event_id")
    status = F.when(i % 4 == 0, "pending").when(i % 4 == 1, "exploring").when(i % 4 == 2, "completed").otherwise("expired")
    return S.table(spark, sf, "events").select(
        i.alias("goal_id"), status.alias("status"), F.concat("event_type", (F.col("user_id") % 50).cast("string")).alias("domain"), F.when(i % 2 == 0, "low_density").otherwise("new_term").alias("kind"),
        F.least(F.lit(1.0), F.col("value") / 200).alias("weight"), F.col("ts").alias("touched"),
    )


@query("WITH " + GOALS + f" SELECT status, kind, count(*) AS n, round({exact('weight')} / count(*), 4) AS priority, round(count(*) * 100.0::DOUBLE / 1000, 2) AS usage FROM goals GROUP BY 1, 2")
def goal_usage(spark, sf):
    return P.goal_usage(_goals(spark, sf))


@query("WITH " + GOALS + """,
n AS (SELECT *, floor(weight * 0.8::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS w FROM goals WHERE status = 'pending' AND floor((epoch(TIMESTAMP '2024-01-20') - floor(epoch(touched))) / 60) >= 10)
SELECT goal_id, status AS before, CASE WHEN w < 0.05::DOUBLE THEN 'expired' ELSE 'pending' END AS after, weight AS old_weight, w AS new_weight, CASE WHEN w < 0.05::DOUBLE THEN 'decay_expire' ELSE 'decay' END AS reason FROM n""")
def goal_history(spark, sf):
    """What a cooling changes, row by row."""
    return M.cooling_history(_goals(spark, sf), F.lit("2024-01-20").cast("timestamp_ntz"))


@query("""
WITH have AS (SELECT p_partkey AS goal_id, 'd' || p_partkey AS domain, CASE WHEN p_size % 2 = 0 THEN 'low_density' ELSE 'new_term' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'completed' ELSE 'pending' END AS status, p_size / 100 AS weight, 'old' AS touched FROM part),
new AS (SELECT 1000000 + p_partkey AS goal_id, 'd' || (p_partkey * 2) AS domain, 'new_term' AS kind, 0.9::DOUBLE AS weight FROM part)
SELECT coalesce(h.goal_id, n.goal_id) AS goal_id, coalesce(h.domain, n.domain) AS domain, coalesce(h.kind, n.kind) AS kind, coalesce(h.status, 'pending') AS status, CASE WHEN n.goal_id IS NOT NULL THEN 0.9 ELSE h.weight END::DOUBLE AS weight, CASE WHEN n.goal_id IS NOT NULL THEN 'now' ELSE h.touched END AS touched
FROM (SELECT * FROM have WHERE status = 'pending') h FULL JOIN new n ON h.domain = n.domain AND h.kind = n.kind
UNION ALL SELECT goal_id, domain, kind, status, weight, touched FROM have WHERE status = 'completed'""")
def goals_merged(spark, sf):
    """Triggers renew open goals of their domain and kind, or make new ones."""
    k, z = F.col("p_partkey"), F.col("p_size")
    part = S.table(spark, sf, "part")
    have = part.select(k.alias("goal_id"), F.concat(F.lit("d"), k.cast("string")).alias("domain"), F.when(z % 2 == 0, "low_density").otherwise("new_term").alias("kind"), F.when(z % 3 == 0, "completed").otherwise("pending").alias("status"), (z / 100).alias("weight"), F.lit("old").alias("touched"))
    new = part.select((k + 1_000_000).alias("goal_id"), F.concat(F.lit("d"), (k * 2).cast("string")).alias("domain"), F.lit("new_term").alias("kind"), F.lit(0.9).alias("weight"))
    return M.merged_goals(have, new, F.lit("now"))


@query("WITH t AS (SELECT event_type || (user_id % 50) AS domain, count(*) AS n FROM events GROUP BY 1) SELECT 'goal_' || substr(md5(domain || '|new_term|2024-02-01'), 1, 6) AS goal_id, domain, 'new_term' AS kind FROM t WHERE n > 5")
def goals_terms(spark, sf):
    """Goals of terms that often match nothing."""
    terms = S.table(spark, sf, "events").groupBy(F.concat("event_type", (F.col("user_id") % 50).cast("string")).alias("domain")).agg(F.count("*").alias("n"))
    return M.term_goals(terms, F.lit("2024-02-01"))


@query(with_(EDGES, GOALS) + """,
last AS (SELECT max(ts) AS t FROM events)
SELECT 'weight' AS kind, source || '|' || target AS subject, weight + 1.2::DOUBLE AS value FROM edges WHERE weight + 1.2::DOUBLE > 1.8::DOUBLE
UNION ALL SELECT 'conflict', 'd' || p_partkey, p_size::DOUBLE FROM part WHERE p_size > 10
UNION ALL SELECT 'pool', 'goals', n FROM (SELECT count(*)::DOUBLE AS n FROM goals WHERE status IN ('pending', 'exploring')) WHERE n > 80
UNION ALL SELECT 'channel', event_type, count(*)::DOUBLE FROM events, last WHERE user_id % 2 = 0 AND ts > t - INTERVAL 5 MINUTES GROUP BY 2 HAVING count(*) > 5""")
def alerts_all(spark, sf):
    """Every kind of alert: weights, conflicts, a full pool, channels that lag."""
    e = S.table(spark, sf, "events")
    monitors = S.table(spark, sf, "part").select(S.key("meta", "p_partkey").alias("label"), F.create_map(F.lit("conflict_frequency"), F.col("p_size").cast("double")).alias("metrics"))
    monitors = monitors.withColumn("label", F.regexp_replace("label", "^meta:", "meta:d"))
    events = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("last")))).select(F.col("event_type").alias("channel"), "ts", "last", (F.col("user_id") % 2 == 1).alias("processed"))  # one row
    edges = S.edges(spark, sf).withColumn("weight", F.col("weight") + 1.2)
    return P.alerts(edges, monitors, _goals(spark, sf), events, F.col("last"), pool=100)


@query(with_(SEEDS, PART_EDGES, HISTORY) + """
SELECT 'total' AS part, 'nodes' AS name, count(*) AS n FROM seeds UNION ALL SELECT 'total', 'edges', count(*) FROM part_edges UNION ALL SELECT 'total', 'queries', count(*) FROM history
UNION ALL SELECT 'type', type, count(*) FROM seeds GROUP BY type UNION ALL SELECT 'domain', coalesce(nullif(domain, ''), '未分类'), count(*) FROM seeds GROUP BY 2
UNION ALL SELECT 'relation', relation, count(*) FROM part_edges GROUP BY relation UNION ALL SELECT 'history', domain, count(*) FROM history GROUP BY domain
UNION ALL SELECT 'pool', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus""")
def status_rollup(spark, sf):
    """Totals and counts by kind of all tables."""
    return P.status(S.seeds(spark, sf), S.part_edges(spark, sf), S.history(spark, sf), S.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")))


@query("""
WITH t AS (SELECT event_id, date_trunc('second', ts) AS s FROM events)
SELECT event_id, CASE event_id % 6 WHEN 2 THEN s - INTERVAL 8 HOURS WHEN 3 THEN s + INTERVAL 5 HOURS WHEN 4 THEN NULL ELSE s END AS at FROM t""")
def parsed_times(spark, sf):
    """Times with and without zones, with a zone that is none, and a clock without a day."""
    i, day, clock = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    text = F.when(i % 6 == 0, F.concat(day, F.lit("T"), clock)).when(i % 6 == 1, F.concat(day, F.lit(" "), clock, F.lit("Z")))
    text = text.when(i % 6 == 2, F.concat(day, F.lit("T"), clock, F.lit("+08:00"))).when(i % 6 == 3, F.concat(day, F.lit("T"), clock, F.lit("-05:00"))).when(i % 6 == 4, "12:00:00").otherwise(F.concat(day, F.lit("T"), clock, F.lit("+noon")))
    return S.table(spark, sf, "events").select("event_id", T.timestamp_of(text).cast("timestamp_ntz").alias("at"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, sf):
    """Counts per event type that a stream keeps, read after its last trigger."""
    folder = fresh_path(spark, "stream-counts")
    S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/in")
    B.count_into(B.events(spark, f"{folder}/in", 8), ["event_type"], folder).awaitTermination()
    return B.counted(spark, ["event_type"], folder)


@query(with_(PART_EDGES, MATCHED, ripple(2)) + """,
top AS (SELECT query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY activation DESC, label) AS rank FROM state2) WHERE rank <= 20)
SELECT DISTINCT p.query_id, p.source, p.target FROM paths p JOIN top a ON a.query_id = p.query_id AND a.label = p.source JOIN top b ON b.query_id = p.query_id AND b.label = p.target""")
def learning_top(spark, sf):
    """Learning paths between the 20 most active nodes of each query only."""
    run = R.ripple(S.matched(spark, sf), S.part_edges(spark, sf))
    return R.learning_paths(run.paths, R.top_seeds(run.activated)).select("query_id", "source", "target")
