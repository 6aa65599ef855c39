"""Queries over lookups that fall back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgraph.operators import graph as G
from rillgraph.operators import imports as I
from rillgraph.operators import lookup as K
from rillgraph.plans.graph_queries import query
from rillgraph.plans.sql import EDGES, PART_EDGES, PERSONAL, SEEDS, with_
from rillgraph.session import fresh_path
from rillgraph.sources import graph as S
from rillgraph.sources import optional

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

FOUND = f"""
asked AS (SELECT DISTINCT word FROM probes WHERE word IS NOT NULL),
e AS (SELECT word, 'exact' AS how, count(DISTINCT label) AS n, min(label) AS label FROM asked JOIN labels ON label = word GROUP BY word),
a AS (SELECT word, 'alias' AS how, count(DISTINCT label) AS n, min(label) AS label FROM asked JOIN aliases ON alias = word WHERE word NOT IN (SELECT word FROM e) GROUP BY word),
c AS (SELECT word, 'contains' AS how, count(DISTINCT label) AS n, min(label) AS label FROM asked JOIN labels ON contains({LOW.format('label')}, {LOW.format('word')}) WHERE word <> '' AND word NOT IN (SELECT word FROM e) AND word NOT IN (SELECT word FROM a) GROUP BY word),
found AS (SELECT asked.word, coalesce(how, 'miss') AS how, coalesce(n, 0) AS n, label FROM asked LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM a UNION ALL SELECT * FROM c) h ON h.word = asked.word)"""

PARTS = """
labels AS (SELECT p_name || ' ' || p_partkey AS label FROM part),
aliases AS (SELECT p_brand || '/' || p_partkey AS alias, p_name || ' ' || p_partkey AS label FROM part WHERE p_size <= 25),
probes AS (
  SELECT CASE p_partkey % 6 WHEN 0 THEN p_name || ' ' || p_partkey WHEN 1 THEN p_brand || '/' || p_partkey WHEN 2 THEN upper(substr(p_name, 3, 9)) WHEN 3 THEN p_partkey::VARCHAR WHEN 4 THEN substr(p_name, 1, 2) || '%' ELSE p_partkey || ' ' END AS word FROM part
  UNION ALL SELECT NULL UNION ALL SELECT '')"""


def _parts(spark, sf):
    part = S.table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    label, alias, turn = F.concat_ws(" ", "p_name", key), F.concat_ws("/", "p_brand", key), F.col("p_partkey") % 6
    word = F.when(turn == 0, label).when(turn == 1, alias).when(turn == 2, F.upper(F.substring("p_name", 3, 9))).when(turn == 3, key).when(turn == 4, F.concat(F.substring("p_name", 1, 2), F.lit("%"))).otherwise(F.concat(key, F.lit(" ")))
    probes = part.select(word.alias("word")).unionAll(spark.createDataFrame([(None,), ("",)], "word string"))
    return part.select(label.alias("label")), part.filter("p_size <= 25").select(alias.alias("alias"), label.alias("label")), probes


@query("WITH " + PARTS + "," + FOUND + " SELECT * FROM found")
def lookup_fallback(spark, sf):
    """Words looked up among names of parts: as they are, as aliases, as parts of them in either case."""
    labels, aliases, probes = _parts(spark, sf)
    return K.found(probes, labels, aliases)


@query(with_(SEEDS, EDGES) + """,
labels AS (SELECT label FROM seeds),
aliases AS (SELECT definition AS alias, label FROM seeds WHERE label LIKE 'nation:%'),
probes AS (SELECT n_name AS word FROM nation UNION ALL SELECT 'brand:' || p_brand FROM part UNION ALL SELECT r_name FROM region UNION ALL SELECT 'LIER:1'),""" + FOUND + """,
tagged AS (SELECT relation, CASE relation WHEN 'COOCCURS_WITH' THEN 'orders' WHEN 'HAS' THEN 'stock' ELSE '' END AS tag FROM edges)
SELECT 'total' AS part, 'nodes' AS name, count(*) AS n FROM seeds UNION ALL SELECT 'total', 'with definition', count(*) FROM seeds WHERE definition <> '' UNION ALL SELECT 'total', 'with domain', count(*) FROM seeds WHERE domain <> ''
UNION ALL SELECT 'total', 'edges', count(*) FROM tagged UNION ALL SELECT 'relation', relation, count(*) FROM tagged GROUP BY relation UNION ALL SELECT 'tag', coalesce(nullif(tag, ''), '未分类'), count(*) FROM tagged GROUP BY 2
UNION ALL SELECT 'probe ' || how, word, n FROM found""")
def import_summary(spark, sf):
    """What an import gave: totals, edges by relation and tag, and probe words."""
    seeds = S.seeds(spark, sf)
    tag = F.when(F.col("relation") == "COOCCURS_WITH", "orders").when(F.col("relation") == "HAS", "stock").otherwise("")
    t = lambda name, c: S.table(spark, sf, name).select(c.alias("word"))
    probes = t("nation", F.col("n_name")).unionAll(t("part", S.key("brand", "p_brand"))).unionAll(t("region", F.col("r_name"))).unionAll(spark.createDataFrame([("LIER:1",)], "word string"))
    aliases = seeds.filter("label like 'nation:%'").select(F.col("definition").alias("alias"), "label")
    return K.import_summary(seeds, S.edges(spark, sf).withColumn("tag", tag), aliases, probes)


@query(with_(SEEDS, PART_EDGES, PERSONAL) + f""",
pool AS (SELECT source, target FROM personal GROUP BY source, target, relation HAVING count(DISTINCT user_label) < 3),
own AS (SELECT source FROM part_edges JOIN part ON source = 'part:' || p_partkey WHERE p_type NOT IN ('ECONOMY', 'PROMO')),
d AS (SELECT p_type AS domain FROM part UNION SELECT p_brand FROM part UNION SELECT upper(n_name) FROM nation UNION SELECT 'geo' UNION SELECT 'PART:1' UNION SELECT 'r'),
i AS (SELECT DISTINCT domain FROM seeds JOIN own ON source = label WHERE domain <> ''),
s AS (SELECT DISTINCT domain FROM pool JOIN seeds ON label = source), t AS (SELECT DISTINCT domain FROM pool JOIN seeds ON label = target),
c AS (SELECT DISTINCT domain FROM d JOIN (SELECT source AS x FROM pool UNION SELECT target FROM pool) ON contains({LOW.format('x')}, {LOW.format('domain')})),
b AS (SELECT domain, domain IN (SELECT domain FROM i) AS inside, CASE WHEN domain IN (SELECT domain FROM s) THEN 'source' WHEN domain IN (SELECT domain FROM t) THEN 'target' WHEN domain IN (SELECT domain FROM c) THEN 'contains' END AS how FROM d)
SELECT domain, CASE WHEN inside THEN 'internal' WHEN how IS NOT NULL THEN 'candidate_upgrade' ELSE 'external' END AS strategy, CASE WHEN NOT inside THEN how END AS by FROM b""")
def explore_fallback(spark, sf):
    """Strategies of domains from the graph and the pool of personal edges, by name where nothing else is known."""
    part = S.table(spark, sf, "part")
    t = lambda name, c: S.table(spark, sf, name).select(c.alias("domain"))
    domains = t("part", F.col("p_type")).unionAll(t("part", F.col("p_brand"))).unionAll(t("nation", F.upper("n_name"))).unionAll(spark.createDataFrame([("geo",), ("PART:1",), ("r",)], "domain string"))
    own = part.filter("p_type not in ('ECONOMY', 'PROMO')").select(S.key("part", "p_partkey").alias("source"))
    pool = S.personal(spark, sf).groupBy("source", "target", "relation").agg(F.count_distinct("user_label").alias("n"))
    pool = pool.withColumn("status", F.when(F.col("n") >= 3, "upgraded").otherwise("pending"))
    return K.strategies(domains, S.seeds(spark, sf), S.part_edges(spark, sf).join(own, "source", "left_semi"), pool, external=True)


@query(with_(SEEDS, PART_EDGES) + """,
b AS (SELECT label, CASE WHEN label LIKE 'part:%' THEN '' ELSE domain END AS domain, definition FROM seeds WHERE type <> 'USER'),
up AS (SELECT x.label, min(p.domain) AS d FROM b x JOIN part_edges e ON e.source = x.label AND relation = 'IS_A' JOIN b p ON p.label = e.target WHERE coalesce(x.domain, '') = '' AND p.domain <> '' GROUP BY 1),
c AS (SELECT 'supplier:' || s_suppkey AS label, contains(n_name, '1') OR contains(n_name, '2') AS hit FROM supplier JOIN nation ON n_nationkey = s_nationkey),
m AS (
  SELECT run, lost, b.label, CASE WHEN up.d IS NOT NULL THEN 'is_a' WHEN contains(lower(definition), '00000001') THEN 'dictionary' WHEN run = 'good' AND coalesce(hit, false) THEN 'category' ELSE 'fallback' END AS method
  FROM (VALUES ('absent', 0), ('corrupt', 2), ('good', 3)) r(run, lost), b LEFT JOIN up USING (label) LEFT JOIN c USING (label) WHERE coalesce(b.domain, '') = '')
SELECT run, run AS outcome, lost::BIGINT AS lost, 'method' AS part, method AS name, count(*) AS n FROM m GROUP BY ALL
UNION ALL SELECT run, run, lost, 'total', 'empty', count(*) FROM m GROUP BY ALL UNION ALL SELECT run, run, lost, 'total', 'default', count(*) FILTER (method = 'fallback') FROM m GROUP BY ALL
UNION ALL SELECT run, run, lost, 'total', 'cycles', 0 FROM m GROUP BY ALL UNION ALL SELECT run, run, lost, 'total', 'with domain', (SELECT count(*) FROM b) FROM m GROUP BY ALL""")
def domain_optional(spark, sf):
    """Domain inference with a category file that is absent, corrupt and good, and what each method gave."""
    nodes = S.seeds(spark, sf).filter("type <> 'USER'").withColumn("domain", F.when(F.col("label").startswith("part:"), "").otherwise(F.col("domain")))
    folder = fresh_path(spark, "optional")
    named = S.table(spark, sf, "supplier").join(S.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    lines = named.select(F.to_json(F.struct(S.key("supplier", "s_suppkey").alias("title"), F.col("n_name").alias("category"))).alias("value"))
    broken = spark.createDataFrame([("{broken",), ('{"title": ',)], "value string")
    broken.write.text(f"{folder}/corrupt")
    lines.unionAll(broken).unionAll(spark.createDataFrame([('{"category": "no title"}',)], "value string")).write.text(f"{folder}/good")
    words = (nodes.select(F.col("label").alias("id"), F.col("definition").alias("text")), spark.createDataFrame([("00000001", "first")], "keyword string, domain string"))
    keywords = spark.createDataFrame([(0, "1", "one"), (1, "2", "two")], "pos int, keyword string, domain string")
    ascent = G.infer_domains(nodes, S.part_edges(spark, sf))
    out = None
    for run in ("absent", "corrupt", "good"):
        file = optional.json_lines(spark, f"{folder}/{run}", "title string, category string", "title")
        categories = None if file.rows is None else (file.rows.select(F.col("title").alias("id"), F.lit(0).alias("pos"), "category"), keywords)
        chain = I.chained_domains(nodes, None, words, categories, ascent=ascent)
        rows = I.inference_report(nodes, chain).select(F.lit(run).alias("run"), F.lit(file.outcome).alias("outcome"), F.lit(file.lost).cast("long").alias("lost"), "part", "name", "n")
        out = rows if out is None else out.unionByName(rows)
    return out
