"""The graph of rillgraph.sources.graph in SQL: common table expressions that the oracles begin with."""

from __future__ import annotations

SEEDS = """
brand_types AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type),
brands AS (SELECT p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn FROM brand_types) WHERE rn = 1),
seeds AS (
  SELECT 'region:' || r_regionkey AS label, 'CONCEPT' AS type, 'geo' AS domain, r_name AS definition FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'CONCEPT', 'geo', n_name FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'CONCEPT', '', s_name FROM supplier
  UNION ALL SELECT 'user:' || c_custkey, 'USER', '', c_name FROM customer
  UNION ALL SELECT 'part:' || p_partkey, 'CONCEPT', p_type, p_name FROM part
  UNION ALL SELECT 'brand:' || p_brand, 'CONCEPT', p_type, '' FROM brands)"""

PART_EDGES = """
items AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
together AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2),
part_edges AS MATERIALIZED (
  SELECT 'part:' || a AS source, 'part:' || b AS target, 'COOCCURS_WITH' AS relation, CASE WHEN n >= 4 THEN 0.7 WHEN n = 3 THEN 0.5 ELSE 0.3 END::DOUBLE AS weight FROM together
  UNION ALL SELECT 'part:' || p_partkey, 'brand:' || p_brand, 'IS_A', 0.8::DOUBLE FROM part)"""

EDGES = PART_EDGES + """,
has_avg AS (SELECT l_suppkey, l_partkey, round(1 - sum(l_discount::DECIMAL(10,4))::DOUBLE / count(*), 6) AS c FROM lineitem GROUP BY 1, 2),
edges AS (
  SELECT * FROM part_edges
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'LOCATED_IN', 0.8::DOUBLE FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN', 0.8::DOUBLE FROM supplier
  UNION ALL SELECT 'user:' || c_custkey, 'nation:' || c_nationkey, 'LOCATED_IN', 0.8::DOUBLE FROM customer
  UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'HAS', CASE WHEN c >= .9 THEN 0.7 WHEN c >= .7 THEN 0.5 WHEN c >= .5 THEN 0.3 ELSE 0 END::DOUBLE FROM has_avg WHERE c >= .5)"""

MATCHED = """
matched AS (SELECT DISTINCT l_orderkey AS query_id, 'part:' || l_partkey AS label FROM lineitem)"""

PERSONAL = """
personal AS (
  SELECT 'user:' || o_custkey AS user_label, 'part:' || l_partkey AS source, 'brand:' || p_brand AS target, 'IS_A' AS relation, least(2.0::DOUBLE, 0.5::DOUBLE + n * 0.1::DOUBLE) AS weight
  FROM (SELECT o_custkey, l_partkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING count(*) >= 2) JOIN part ON p_partkey = l_partkey)"""

HISTORY = """
history AS (
  SELECT event_id AS query_id, ts AS created_at, user_id, event_type AS domain, least(1.0::DOUBLE, value / 100) AS confidence,
         CASE WHEN least(1.0::DOUBLE, value / 100) >= 0.7::DOUBLE THEN 1 WHEN least(1.0::DOUBLE, value / 100) < 0.3::DOUBLE THEN -1 ELSE 0 END AS direction,
         (props->>'$.k')::BIGINT AS k
  FROM events)"""

#: A sum that does not depend on order, as rillgraph.functions.columns.exact_sum.
def exact(value: str) -> str:
    return f"sum(round({value}, 9)::DECIMAL(28,9))::DOUBLE"


def ripple(depth: int, edges: str = "part_edges", virtual: bool = False) -> str:
    """Unrolled waves from matched over edges, without users: state{depth} and paths. virtual: global weights as they are."""
    weight = "e.weight" if virtual else "e.weight * 0.7::DOUBLE"
    parts = ["""
state0 AS (SELECT query_id, label, 1.0::DOUBLE AS activation, 0 AS depth, NULL::VARCHAR AS parent FROM matched)"""]
    for w in range(1, depth + 1):
        parts.append(f"""
hop{w} AS MATERIALIZED (
  SELECT s.query_id, s.label AS source, e.target, e.relation, {weight} AS weight, {w} AS depth, s.activation * ({weight}) * {0.7**w!r}::DOUBLE AS contribution
  FROM state{w - 1} s JOIN {edges} e ON e.source = s.label WHERE s.depth = {w - 1} AND e.source NOT LIKE 'meta:%'),
gain{w} AS (SELECT query_id, target AS label, {exact('contribution')} AS gain, (list(source ORDER BY contribution DESC, source))[1] AS origin FROM hop{w} GROUP BY 1, 2),
state{w} AS MATERIALIZED (
  SELECT coalesce(s.query_id, g.query_id) AS query_id, coalesce(s.label, g.label) AS label, least(2.0::DOUBLE, coalesce(s.activation, 0) + coalesce(g.gain, 0)) AS activation,
         coalesce(s.depth, {w}) AS depth, CASE WHEN s.depth IS NULL THEN g.origin ELSE s.parent END AS parent
  FROM state{w - 1} s FULL JOIN gain{w} g ON s.query_id = g.query_id AND s.label = g.label)""")
    parts.append("\npaths AS (" + " UNION ALL ".join(f"SELECT * FROM hop{w}" for w in range(1, depth + 1)) + ")")
    return ",".join(parts)


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts)
