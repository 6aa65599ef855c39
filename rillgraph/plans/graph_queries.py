"""Queries over the graph: activation, statistics, import, inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.functions.columns import cold_factor, related_weight
from rillgraph.functions.text import round_half
from rillgraph.operators import graph as G
from rillgraph.operators import ripple as R
from rillgraph.plans.sql import EDGES, MATCHED, PART_EDGES, PERSONAL, SEEDS, exact, ripple, with_
from rillgraph.sources import graph as S

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _ripple(spark: SparkSession, sf: str, depth: int) -> R.Ripple:
    return R.ripple(S.matched(spark, sf), S.part_edges(spark, sf), depth)


def _activated(spark: SparkSession, sf: str, depth: int = 2) -> DataFrame:
    return R.activated(S.matched(spark, sf), S.part_edges(spark, sf), depth)


STATE = "SELECT query_id, label, round(activation, 6) AS activation, depth::BIGINT AS depth, parent FROM "


def _state(df: DataFrame) -> DataFrame:
    return df.select("query_id", "label", round_half(F.col("activation"), 6).alias("activation"), F.col("depth").cast("long").alias("depth"), "parent")


@query(with_(PART_EDGES, MATCHED, ripple(1)) + STATE + "state1")
def ripple_depth1(spark, sf):
    return _state(_activated(spark, sf, 1))


@query(with_(PART_EDGES, MATCHED, ripple(2)) + STATE + "state2")
def ripple_depth2(spark, sf):
    return _state(_activated(spark, sf, 2))


@query(with_(EDGES, MATCHED, PERSONAL) + """,
asked AS (SELECT o_orderkey AS query_id, 'user:' || o_custkey AS user_label FROM orders),
cold AS (SELECT 'user:' || o_custkey AS user_label, least(count(*) / 20.0::DOUBLE, 1.0::DOUBLE) AS factor FROM orders GROUP BY o_custkey),
pre AS (
  SELECT query_id, user_label AS label, 0.5::DOUBLE AS activation, 0 AS depth, NULL AS parent FROM asked
  UNION ALL SELECT a.query_id, e.target, max(0.5::DOUBLE * e.weight * 0.7::DOUBLE), 1, min(a.user_label) FROM asked a JOIN edges e ON e.source = a.user_label GROUP BY 1, 2),
state0 AS (
  SELECT query_id, label, 1.0::DOUBLE AS activation, 0 AS depth, NULL AS parent FROM matched
  UNION ALL SELECT * FROM pre p WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.query_id = p.query_id AND m.label = p.label)),
hop AS (
  SELECT m.query_id, m.label AS source, e.target, (e.weight * 0.7::DOUBLE + coalesce(p.weight, 0.0) * 0.3::DOUBLE * coalesce(c.factor, 1.0)) * 0.7::DOUBLE AS contribution
  FROM matched m JOIN edges e ON e.source = m.label LEFT JOIN asked a ON a.query_id = m.query_id
  LEFT JOIN personal p ON p.user_label = a.user_label AND p.source = e.source AND p.target = e.target AND p.relation = e.relation
  LEFT JOIN cold c ON c.user_label = a.user_label),
gain AS (SELECT query_id, target AS label, """ + exact("contribution") + """ AS gain, (list(source ORDER BY contribution DESC, source))[1] AS origin FROM hop GROUP BY 1, 2)
SELECT coalesce(s.query_id, g.query_id) AS query_id, coalesce(s.label, g.label) AS label, round(least(2.0::DOUBLE, coalesce(s.activation, 0) + coalesce(g.gain, 0)), 6) AS activation,
       coalesce(s.depth, 1)::BIGINT AS depth, CASE WHEN s.depth IS NULL THEN g.origin ELSE s.parent END AS parent
FROM state0 s FULL JOIN gain g ON s.query_id = g.query_id AND s.label = g.label""")
def ripple_user(spark, sf):
    """Pre-activation by the user's node, personal weights and the cold factor."""
    orders = S.table(spark, sf, "orders")
    users = orders.select(F.col("o_orderkey").alias("query_id"), S.key("user", "o_custkey").alias("user_label"))
    cold = users.groupBy("user_label").agg(cold_factor(F.count("*")).alias("factor"))
    rows = S.table(spark, sf, "lineitem").count()
    return _state(R.activated_for_users(S.matched(spark, sf), S.edges(spark, sf), users, S.personal(spark, sf), cold, rows))


@query(with_(PART_EDGES, MATCHED, ripple(2)) + """
SELECT query_id, source, target, relation, round(contribution, 6) AS contribution, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY contribution DESC, source, target, relation) AS rank FROM paths) WHERE rank <= 10""")
def ripple_paths_topk(spark, sf):
    top = R.top_paths(_ripple(spark, sf, 2).paths)
    return top.select("query_id", "source", "target", "relation", round_half(F.col("contribution"), 6).alias("contribution"), F.col("rank").cast("long").alias("rank"))


SCORES = f"""
scores AS (
  SELECT query_id, coalesce(nullif(domain, ''), '常识') AS domain, {exact('activation')} AS score
  FROM state2 LEFT JOIN seeds USING (label) GROUP BY 1, 2)"""


@query(with_(SEEDS, PART_EDGES, MATCHED, ripple(2), SCORES) + "SELECT query_id, domain, score FROM scores")
def domain_scores(spark, sf):
    scores = R.domain_scores(_activated(spark, sf), S.seeds(spark, sf))
    return scores


@query(with_(SEEDS, PART_EDGES, MATCHED, ripple(2), SCORES) + """
SELECT query_id, string_agg(domain, ',' ORDER BY score DESC, domain) AS domains FROM scores WHERE score >= 0.3::DOUBLE GROUP BY query_id""")
def selected_domains(spark, sf):
    scores = R.domain_scores(_activated(spark, sf), S.seeds(spark, sf))
    return R.selected_domains(scores).select("query_id", F.array_join("domains", ",").alias("domains"))


@query(with_(PART_EDGES, MATCHED, ripple(2)) + """
SELECT query_id, label, round(activation, 6) AS activation, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY activation DESC, label) AS rank FROM state2) WHERE rank <= 20""")
def top_seeds(spark, sf):
    top = R.top_seeds(_activated(spark, sf))
    return top.select("query_id", "label", round_half(F.col("activation"), 6).alias("activation"), F.col("rank").cast("long").alias("rank"))


@query(with_(PART_EDGES, MATCHED, ripple(2)) + """,
used AS (SELECT *, sum(length(label)) OVER (PARTITION BY query_id ORDER BY activation DESC, label ROWS UNBOUNDED PRECEDING) AS used FROM state2)
SELECT query_id, label, used::BIGINT AS used FROM used WHERE used <= 40""")
def budget_prefix(spark, sf):
    """The context budget: a query's nodes, most active first, while their lengths add up to 40 at most."""
    rows = _activated(spark, sf).withColumn("cost", F.length("label").cast("long"))
    return R.within_budget(rows, "cost", [F.desc("activation"), "label"], 40).select("query_id", "label", "used")


@query(with_(SEEDS) + "SELECT label, type, domain, definition FROM seeds")
def seed_build(spark, sf):
    return S.seeds(spark, sf)


@query(with_(EDGES) + "SELECT source, target, relation, weight FROM edges")
def edge_build(spark, sf):
    return S.edges(spark, sf)


@query("""
WITH t AS (SELECT l_suppkey AS s, l_partkey AS o, round(max(l_tax * 10), 6) AS c FROM lineitem GROUP BY 1, 2)
SELECT s, o, round(CASE WHEN c > 0 THEN 0.1::DOUBLE + 0.6::DOUBLE * c ELSE 0.1::DOUBLE END, 6) AS weight FROM t""")
def import_related_weights(spark, sf):
    """Parallel RELATED import: one weight per (s, o)."""
    t = S.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("o")).agg(F.round(F.max(F.col("l_tax") * 10), 6).alias("c"))
    return t.select("s", "o", F.round(related_weight(F.col("c")), 6).alias("weight"))


@query("""
WITH old AS (SELECT 'brand:' || p_brand AS label, p_type AS a FROM part WHERE p_size <= 25 UNION ALL SELECT 'brand:' || p_brand, lower(p_type) FROM part WHERE p_size > 25)
SELECT label, string_agg(DISTINCT a, ',' ORDER BY a) AS aliases, count(DISTINCT a)::BIGINT AS n FROM old GROUP BY label""")
def alias_merge(spark, sf):
    part = S.table(spark, sf, "part")
    old = part.filter("p_size <= 25").groupBy(S.key("brand", "p_brand").alias("label")).agg(F.collect_set("p_type").alias("aliases"))
    new = part.filter("p_size > 25").groupBy(S.key("brand", "p_brand").alias("label")).agg(F.collect_set(F.lower("p_type")).alias("aliases"))
    return G.merge_aliases(old, new).select("label", F.array_join("aliases", ",").alias("aliases"), F.size("aliases").cast("long").alias("n"))


@query("""
WITH own AS (SELECT 'part:' || p_partkey AS label, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS definition, p_type AS domain FROM part),
d AS (SELECT 'part:' || (p_partkey + 100) AS label, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS one, p_type || '; ' || p_brand AS many FROM part),
dict AS (SELECT label, coalesce(nullif(one, ''), many) AS def FROM d)
SELECT coalesce(o.label, d.label) AS label,
       CASE WHEN d.def IS NOT NULL AND (coalesce(o.definition, '') = '' OR length(d.def) > length(o.definition)) THEN d.def ELSE coalesce(o.definition, '') END AS definition,
       coalesce(o.domain, '成语', '') AS domain
FROM own o FULL JOIN dict d ON o.label = d.label""")
def definition_fill(spark, sf):
    """Dictionary definitions: fill empty ones, replace shorter ones, insert the rest with the domain of idioms."""
    part = S.table(spark, sf, "part")
    own = part.select(S.key("part", "p_partkey").alias("label"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("definition"), F.col("p_type").alias("domain"))
    words = part.select(
        F.concat(F.lit("part:"), (F.col("p_partkey") + 100).cast("string")).alias("word"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("definition"),
        F.array("p_type", "p_brand").alias("definitions"), F.lit("成语").alias("domain"),
    )
    return G.fill_definitions(own, words, longer=True)


@query(r"""
WITH t AS (SELECT DISTINCT regexp_extract(url, '[^/]*$') AS title FROM pages UNION SELECT DISTINCT p_name FROM part)
SELECT title FROM t WHERE length(title) >= 2 AND NOT regexp_matches(title, '[{}\[\]<>|\\/"''+=&%$#@!~`^*]') AND title NOT IN (SELECT p_type FROM part)""")
def title_filter(spark, sf):
    titles = S.table(spark, sf, "pages").select(F.regexp_extract("url", "[^/]*$", 0).alias("title"))
    part = S.table(spark, sf, "part")
    return G.new_titles(titles.unionAll(part.select("p_name")), part.select(F.col("p_type").alias("label")))


@query(with_(SEEDS) + """,
owners AS (SELECT p_name AS alias, (list('part:' || p_partkey ORDER BY p_partkey))[1] AS label FROM part GROUP BY p_name),
names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT 'part:' || (p_partkey * 2) FROM part UNION SELECT DISTINCT p_type FROM part)
SELECT name, coalesce(s.label, o.label) AS label, CASE WHEN s.label IS NOT NULL THEN 'exact' WHEN o.label IS NOT NULL THEN 'alias' ELSE 'miss' END AS how
FROM names LEFT JOIN seeds s ON s.label = name LEFT JOIN owners o ON o.alias = name""")
def seed_lookup_alias(spark, sf):
    part = S.table(spark, sf, "part")
    nodes = part.select(S.key("part", "p_partkey").alias("label"), F.array("p_name").alias("aliases"), F.col("p_partkey").alias("ord"))
    names = part.select(F.col("p_name").alias("name")).union(part.select(F.concat(F.lit("part:"), (F.col("p_partkey") * 2).cast("string")))).union(part.select("p_type")).distinct()
    return G.lookup(names, S.seeds(spark, sf), G.alias_index(nodes))


@query(with_(SEEDS, EDGES) + """
SELECT (SELECT count(*) FROM seeds) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM seeds WHERE definition <> '') AS with_definition, (SELECT count(*) FROM seeds WHERE domain <> '') AS with_domain""")
def graph_stats(spark, sf):
    n = S.seeds(spark, sf).agg(F.count("*").alias("nodes"), F.count_if(F.col("definition") != "").alias("with_definition"), F.count_if(F.col("domain") != "").alias("with_domain"))
    return n.crossJoin(S.edges(spark, sf).agg(F.count("*").alias("edges")))  # one row each


@query(with_(EDGES) + "SELECT relation, count(*) AS n FROM edges GROUP BY relation")
def relation_counts(spark, sf):
    return S.edges(spark, sf).groupBy("relation").agg(F.count("*").alias("n"))


@query(with_(SEEDS) + "SELECT coalesce(nullif(domain, ''), '未分类') AS domain, type, count(*) AS n FROM seeds GROUP BY 1, 2")
def domain_distribution(spark, sf):
    from rillgraph.functions.columns import domain_or

    return S.seeds(spark, sf).groupBy(domain_or(F.col("domain"), "未分类").alias("domain"), "type").agg(F.count("*").alias("n"))


@query(with_(EDGES) + "SELECT source AS label, count(*) AS degree FROM edges GROUP BY source")
def out_degree(spark, sf):
    return G.out_degree(S.edges(spark, sf))


@query(with_(EDGES) + f"SELECT source AS label, {exact('weight')} AS total, count(*) AS degree FROM edges GROUP BY source ORDER BY total DESC, label LIMIT 10")
def hottest(spark, sf):
    return G.hottest(S.edges(spark, sf))


@query(with_(EDGES) + f"SELECT source AS label, {exact('weight')} AS total, count(*) AS degree FROM edges GROUP BY source ORDER BY total, label LIMIT 10")
def coldest(spark, sf):
    return G.coldest(S.edges(spark, sf))


@query(with_(EDGES) + "SELECT source, target, relation, weight FROM edges ORDER BY weight DESC, source, target, relation LIMIT 10")
def heaviest(spark, sf):
    return G.heaviest(S.edges(spark, sf))


@query(with_(SEEDS, EDGES) + f"SELECT coalesce(nullif(domain, ''), '未分类') AS domain, round({exact('weight')} / count(*), 4) AS density, count(*) AS edges FROM edges JOIN seeds ON label = source GROUP BY 1")
def domain_density(spark, sf):
    return G.domain_density(S.edges(spark, sf), S.seeds(spark, sf))


@query(with_(EDGES) + f"SELECT relation, round({exact('weight')} / count(*), 4) AS quality, count(*) AS edges FROM edges GROUP BY relation")
def relation_quality(spark, sf):
    return G.relation_quality(S.edges(spark, sf))


@query(with_(EDGES) + f"SELECT round({exact('weight')} / count(*), 6) AS density FROM edges")
def global_density(spark, sf):
    from rillgraph.functions.columns import exact_sum

    return S.edges(spark, sf).agg(F.round(exact_sum(F.col("weight")) / F.count("*"), 6).alias("density"))


@query(with_(SEEDS, EDGES) + """,
deg AS (SELECT source, count(*) AS d FROM edges GROUP BY source),
r AS (SELECT domain, label, coalesce(d, 0) AS degree, row_number() OVER (PARTITION BY domain ORDER BY coalesce(d, 0) DESC, label) AS rank FROM seeds LEFT JOIN deg ON source = label WHERE domain <> '')
SELECT * FROM r WHERE rank <= 5""")
def core_seeds(spark, sf):
    return G.core_seeds(S.seeds(spark, sf), S.edges(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query(with_(SEEDS, PART_EDGES) + "SELECT label, type, domain FROM seeds WHERE type <> 'USER' AND label NOT IN (SELECT source FROM part_edges) AND label NOT IN (SELECT target FROM part_edges)")
def orphans(spark, sf):
    return G.orphans(S.seeds(spark, sf), S.part_edges(spark, sf))


@query(with_(PART_EDGES) + """,
pairs AS (SELECT DISTINCT least('part:' || a.l_partkey, 'part:' || b.l_partkey) AS a, greatest('part:' || a.l_partkey, 'part:' || b.l_partkey) AS b FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)
SELECT a, b FROM pairs WHERE NOT EXISTS (SELECT 1 FROM part_edges e WHERE least(e.source, e.target) = pairs.a AND greatest(e.source, e.target) = pairs.b)""")
def missing_edges(spark, sf):
    items = S.ordered(S.table(spark, sf, "lineitem"))
    pairs = items.join(items.select("l_orderkey", F.col("l_partkey").alias("p2")), "l_orderkey").filter("l_partkey < p2")
    return G.missing_edges(pairs.select(S.key("part", "l_partkey").alias("a"), S.key("part", "p2").alias("b")), S.part_edges(spark, sf))


@query(with_(PART_EDGES, MATCHED, ripple(3, virtual=True)) + """,
ranked AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY activation DESC, label) AS i FROM state3 WHERE activation >= 0.1::DOUBLE),
pairs AS (SELECT x.query_id, x.label AS a, y.label AS b, row_number() OVER (PARTITION BY x.query_id ORDER BY x.i, y.i) AS n FROM ranked x JOIN ranked y ON x.query_id = y.query_id AND y.i - x.i BETWEEN 1 AND 4)
SELECT query_id, a, b FROM pairs WHERE n <= 50 AND NOT EXISTS (SELECT 1 FROM part_edges e WHERE least(e.source, e.target) = least(a, b) AND greatest(e.source, e.target) = greatest(a, b))""")
def missing_associations(spark, sf):
    edges = S.part_edges(spark, sf)
    return G.associations(R.activated(S.matched(spark, sf), edges, 3, virtual=True, links=True))


BLANKED = "blanked AS (SELECT label, type, CASE WHEN label LIKE 'part:%' THEN '' ELSE domain END AS domain FROM seeds)"


@query(with_(SEEDS, PART_EDGES, BLANKED) + """,
up AS (SELECT b.label, 1 AS hops, p.domain FROM blanked b JOIN part_edges e ON e.source = b.label AND relation = 'IS_A' JOIN blanked p ON p.label = e.target WHERE coalesce(b.domain, '') = '' AND p.domain <> '')
SELECT b.label, coalesce(min(u.domain), '常识') AS inferred, CASE WHEN min(u.domain) IS NULL THEN 'fallback' ELSE 'is_a' END AS method, min(u.hops)::BIGINT AS hops
FROM blanked b LEFT JOIN up u USING (label) WHERE coalesce(b.domain, '') = '' GROUP BY b.label""")
def domain_infer(spark, sf):
    nodes = S.seeds(spark, sf).withColumn("domain", F.when(F.col("label").startswith("part:"), "").otherwise(F.col("domain")))
    return G.infer_domains(nodes, S.part_edges(spark, sf))


@query(with_(SEEDS) + "SELECT count(*) AS seeds, count(*) FILTER (domain <> '') AS with_domain, round(count(*) FILTER (domain <> '') * 100 / count(*), 4) AS percent FROM seeds")
def domain_coverage(spark, sf):
    return G.domain_coverage(S.seeds(spark, sf))


@query(with_(SEEDS, PART_EDGES) + """,
named AS (SELECT label, domain FROM seeds WHERE domain <> ''),
h1 AS (SELECT DISTINCT n.domain AS origin, e.target AS label FROM named n JOIN part_edges e ON e.source = n.label),
h2 AS (SELECT DISTINCT origin, e.target AS label FROM h1 JOIN part_edges e ON e.source = h1.label),
h3 AS (SELECT DISTINCT origin, e.target AS label FROM h2 JOIN part_edges e ON e.source = h2.label),
h4 AS (SELECT DISTINCT origin, e.target AS label FROM h3 JOIN part_edges e ON e.source = h3.label),
h5 AS (SELECT DISTINCT origin, e.target AS label FROM h4 JOIN part_edges e ON e.source = h4.label),
hits AS (SELECT origin, label, 1 AS hops FROM h1 UNION ALL SELECT origin, label, 2 FROM h2 UNION ALL SELECT origin, label, 3 FROM h3 UNION ALL SELECT origin, label, 4 FROM h4 UNION ALL SELECT origin, label, 5 FROM h5)
SELECT origin, domain AS target, min(hops)::BIGINT AS hops FROM hits JOIN named USING (label) WHERE origin <> domain GROUP BY 1, 2""")
def domain_distance(spark, sf):
    return G.domain_distance(S.seeds(spark, sf), S.part_edges(spark, sf))


@query(with_(PART_EDGES) + """,
near AS (SELECT source AS x, target AS n FROM part_edges UNION SELECT target, source FROM part_edges),
pairs AS (SELECT source AS a, target AS b FROM part_edges WHERE relation = 'COOCCURS_WITH' AND source < target),
size AS (SELECT x, count(*) AS size FROM near GROUP BY x),
shared AS (SELECT a, b, count(*) AS shared FROM pairs JOIN near p ON p.x = a JOIN near q ON q.x = b AND q.n = p.n GROUP BY 1, 2)
SELECT a, b, round(coalesce(shared, 0)::DOUBLE / (sa.size + sb.size - coalesce(shared, 0)), 6) AS jaccard FROM pairs LEFT JOIN shared USING (a, b) JOIN size sa ON sa.x = a JOIN size sb ON sb.x = b""")
def neighbor_jaccard(spark, sf):
    edges = S.part_edges(spark, sf)
    return G.neighbour_jaccard(edges.filter("relation = 'COOCCURS_WITH' and source < target").select(F.col("source").alias("a"), F.col("target").alias("b")), edges)


@query("""
WITH labels AS (SELECT p_name AS label, count(*) AS degree FROM part GROUP BY p_name),
words AS (SELECT DISTINCT substr(p_name, 1, p_size % 5 + 1) || substr(p_name, p_size % 5 + 3) AS word FROM part),
near AS (SELECT word, label, degree, levenshtein(word, label) AS d FROM words, labels WHERE levenshtein(word, label) <= 1)
SELECT word, label, d::BIGINT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, degree DESC, label) AS rn FROM near) WHERE rn = 1""")
def fuzzy_match(spark, sf):
    """Names with one character left out, matched again within one edit."""
    part = S.table(spark, sf, "part")
    labels = part.groupBy(F.col("p_name").alias("label")).agg(F.count("*").alias("degree"))
    cut = F.concat(F.expr("substring(p_name, 1, p_size % 5 + 1)"), F.expr("substring(p_name, p_size % 5 + 3)"))
    return G.fuzzy_match(part.select(cut.alias("word")), labels)


@query("""
WITH kw(keyword, domain) AS (VALUES ('the', 'en'), ('that', 'en-long'), ('der', 'de'), ('para', 'es'), ('dans', 'fr')),
held AS (SELECT doc_id AS id, keyword, domain FROM documents JOIN kw ON contains(lower(text), keyword))
SELECT id, domain FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(keyword) DESC, keyword DESC) AS rn FROM held) WHERE rn = 1""")
def keyword_domain(spark, sf):
    kw = spark.createDataFrame([("the", "en"), ("that", "en-long"), ("der", "de"), ("para", "es"), ("dans", "fr")], "keyword string, domain string")
    return G.keyword_domain(S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), kw)


@query("""
WITH kw(pos, keyword, domain) AS (VALUES (0, 'page', 'site'), (1, 'en', 'english'), (2, 'fr', 'french')),
c AS (SELECT page_id AS id, u.pos, u.category FROM pages, LATERAL (SELECT unnest(string_split(url, '/')) AS category, generate_subscripts(string_split(url, '/'), 1) AS pos) u),
held AS (SELECT c.id, c.pos, kw.pos AS kp, domain FROM c JOIN kw ON contains(category, keyword))
SELECT id, domain FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, kp) AS rn FROM held) WHERE rn = 1""")
def category_domain(spark, sf):
    kw = spark.createDataFrame([(0, "page", "site"), (1, "en", "english"), (2, "fr", "french")], "pos int, keyword string, domain string")
    c = S.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.posexplode(F.split("url", "/")).alias("pos", "category"))
    return G.category_domain(c, kw)


@query("""
WITH p AS (SELECT p_partkey AS i, p_type, p_partkey % 250 AS pos, p_partkey // 250 AS block FROM part),
b AS (SELECT block, count(*) = 250 AS whole, max(CASE WHEN pos = 249 THEN p_type END) AS top FROM p GROUP BY block)
SELECT 'part:' || i AS label, CASE WHEN whole AND block % 2 = 0 THEN top ELSE '常识' END AS inferred, CASE WHEN NOT whole THEN 'fallback' WHEN block % 2 = 0 THEN 'is_a' ELSE 'cycle' END AS method, CASE WHEN whole AND block % 2 = 0 THEN 249 - pos END AS hops
FROM p JOIN b USING (block) WHERE NOT (pos = 249 AND block % 2 = 0)""")
def domain_deep(spark, sf):
    """Chains of 250 parts that end at a domain, and rings of 250: up to 1,000 steps up."""
    i = F.col("p_partkey")
    pos, block = i % 250, F.floor(i / 250)
    part = S.table(spark, sf, "part")
    top = (pos == 249) & (block % 2 == 0)
    nodes = part.select(S.key("part", "p_partkey").alias("label"), F.when(top, F.col("p_type")).otherwise("").alias("domain"))
    to = F.when(pos < 249, i + 1).when(block % 2 == 1, block * 250)
    chain = part.select(S.key("part", "p_partkey").alias("source"), F.concat(F.lit("part:"), to.cast("string")).alias("target"), F.lit("IS_A").alias("relation")).filter("target is not null")
    chain = chain.join(nodes.select(F.col("label").alias("target")), "target", "left_semi")
    return G.infer_domains(nodes, chain, 1000)
