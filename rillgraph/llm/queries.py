"""One query per operator over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm import _common


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillgraph.llm.secrets import digest, scan

    return digest(scan(_common.table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillgraph.llm.vectors import near_vectors

    return near_vectors(_common.table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillgraph.llm.mixing import mix

    return mix(_common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillgraph.llm.quality import classify

    return classify(_common.table(spark, sf_dir, "documents"), _common.table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillgraph.llm.langid import identify

    return identify(_common.table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillgraph.llm import warc

    folder = _common.fresh_path(spark, "warc")
    warc.write(_common.table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillgraph.llm.hamming import top_k

    vectors = _common.table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillgraph.llm.packing import pack, public_words

    return pack(_common.table(spark, sf_dir, "documents"), public_words())


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillgraph.llm.neardup import near_duplicates

    return near_duplicates(_common.table(spark, sf_dir, "documents"), n=2)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillgraph.llm.linededup import dedup_lines

    out = dedup_lines(_common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillgraph.llm.divergence import divergence

    return divergence(_common.table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillgraph.llm.decontaminate import contamination

    return contamination(_common.table(spark, sf_dir, "documents"), _common.table(spark, sf_dir, "benchmark"))


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillgraph.llm.interactions import flagged, steps

    return steps(flagged(_common.table(spark, sf_dir, "documents"), _common.table(spark, sf_dir, "labels")), "ABCDE")


def _op1_sql() -> str:
    """Spans by the lengths of what lies between the matches and of the matches, rule by rule."""
    from rillgraph.llm.secrets import RULES

    letters = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}
    assign = "(" + "|".join("".join(letters.get(c, c) for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    parts = []
    for rank, r in enumerate(RULES):
        pattern = assign if r.kind == "assign" else r.pattern
        parts.append(f"""
  SELECT row_id, '{r.kind}' AS kind, {rank} AS rank, start, start + length(hits[i]) AS stop FROM (
    SELECT row_id, hits, vals, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS start
    FROM (SELECT row_id, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {r.group}) AS vals, string_split_regex(text, '{pattern}') AS gaps FROM d), unnest(generate_series(1, len(hits))) AS u(i))
  WHERE length(vals[i]) >= {r.min_chars}""")
    base = "'assign', 'access', 'hex'"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
agg AS (
  SELECT row_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS base,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (row_id)
"""


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.y, r.root FROM reach r JOIN edges e ON r.node = e.x),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
links AS (SELECT x, count(*) AS n FROM edges GROUP BY x)
SELECT node AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, node = component_id AS kept
FROM least LEFT JOIN links ON x = node
"""

OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / (0.1 + coalesce(length(regexp_replace(text, '[^\p{L} \n]', '', 'g'))::DOUBLE / nullif(length(text), 0), 0.0)) AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM src),
levels AS (
  SELECT *, row_number() OVER f AS place,
         ((SELECT sum(source_size) FROM src) * 1.5::DOUBLE - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW f AS (ORDER BY cap / w, source NULLS LAST)),
fin AS (SELECT place AS first_place, level AS lam FROM levels WHERE level * w <= cap ORDER BY place LIMIT 1),
goal AS (SELECT source, source_size, CASE WHEN place >= first_place THEN lam * w ELSE cap END AS target FROM levels, fin),
run AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size = 0 THEN 0 ELSE floor(g.target / g.source_size) END AS epochs,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN before + size / 2.0::DOUBLE <= target - epochs * source_size AND target > epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""

OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CASE WHEN c > 0 AND NOT isinf(c) THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE embedding IS NOT NULL),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(range(1, greatest(len(q.bits), len(v.bits)) + 1), lambda i: CASE WHEN coalesce(q.bits[i], 0) <> coalesce(v.bits[i], 0) THEN 1 ELSE 0 END)), 0)::INT AS distance
  FROM v q, v WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER w AS rank, vec_id, distance FROM d
WINDOW w AS (PARTITION BY query_id ORDER BY distance, vec_id) QUALIFY row_number() OVER w <= 10
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
                      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM reach r JOIN edges e ON r.node = e.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.root)::BIGINT AS component_id, s.doc_id = min(r.root) AS kept
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.s
"""

OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, row_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(o.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (o.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key
GROUP BY row_id, doc_id
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
occ AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM occ GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, coalesce(sum(n), 0)::HUGEINT AS total, count(term)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM occ GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n, k.n AS lang_n FROM grp g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (
  SELECT c.lang, source, term, c.n, 1 + (1000000000 * (c.n + 2)) // (sum(c.n) OVER (PARTITION BY c.lang, source) + 2 * v)::HUGEINT AS p, 1 + (1000000000 * (lang_n + 2)) // (total + 2 * v) AS q
  FROM cells c JOIN langs l ON l.lang = c.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER w)::INT AS rank FROM parts WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 10
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS u(i) WHERE len(w) > 0),
hit AS (
  SELECT r, i, x.n, s FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM win) AS l, unnest(generate_series(1, len(w) - n + 1)) AS u(i)) x
  SEMI JOIN win ON win.n = x.n AND win.s = x.s),
n_hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS pos FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit JOIN win ON win.n = hit.n AND win.s = hit.s WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN ids USING (r)
"""

OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM t LEFT JOIN marks ON marks.doc_id = t.doc_id),
n AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, mask),
orders AS (
  SELECT '' AS o, 0 AS used, 0 AS k UNION ALL
  SELECT o || letter, used + bit, k + 1 FROM orders, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, bit) WHERE used & bit = 0),
steps AS (
  SELECT o AS filter_order, step, substr(o, step, 1) AS letter, 1 << (ascii(substr(o, step, 1)) - 65) AS bit, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(o, i, 1)) - 65))), 0)::INT AS before
  FROM (SELECT o FROM orders WHERE k = 5), unnest(generate_series(1, 5)) AS s(step)),
x AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed, coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM n, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM x
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_language_id": op5_language_id,
    "op6_warc": op6_warc,
    "op7_top_k": op7_top_k,
    "op8_packing": op8_packing,
    "op9_minhash": op9_minhash,
    "op10_line_dedup": op10_line_dedup,
    "op11_divergence": op11_divergence,
    "op12_decontamination": op12_decontamination,
    "op13_interactions": op13_interactions,
}

ORACLES: dict[str, str] = {"op1_secret_scan": _op1_sql(), "op2_embedding_dedup": OP2_SQL, "op7_top_k": OP7_SQL, "op3_mixing": OP3_SQL, "op6_warc": OP6_SQL, "op9_minhash": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_divergence": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_interactions": OP13_SQL}
