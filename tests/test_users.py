"""Worked examples of users, outside candidates, aliases, monitors and thresholds, with nulls, ties, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from rillgraph.operators import learning as L
from rillgraph.operators import meta as M
from rillgraph.operators import perception as P
from rillgraph.operators import users as U
from rillgraph.operators import verify as V

POOL = "source string, target string, relation string, count long, contributors array<string>, status string"
EDGE = "source string, target string, relation string, weight double"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_resolved(spark):
    mapping = spark.createDataFrame([("web", "1", "mine")], "source string, source_id string, user_id string")
    came = spark.createDataFrame([("web", "1"), ("web", "2"), ("web", "2"), (None, "3"), ("app", None)], "source string, source_id string")
    after, nodes = U.resolved(mapping, came)
    new = nodes.collect()
    assert len(new) == 1 and new[0]["label"].startswith("user_") and len(new[0]["label"]) == 13
    assert (new[0]["type"], new[0]["domain"], new[0]["definition"], new[0]["preferences"]) == ("USER", "用户", "来源:web", {"style": "concise", "level": "expert"})
    assert rows(after, "source_id", "user_id") == sorted([("1", "mine"), ("2", new[0]["label"])])
    again, none = U.resolved(after, came)
    assert none.count() == 0 and rows(again, *again.columns) == rows(after, *after.columns)


def test_own_edges(spark):
    edges = spark.createDataFrame([("u", "a", "RELATED", 0.4)], EDGE)
    own = spark.createDataFrame(
        [("u", "a", "RELATED", 1.0, 1), ("u", "b", "RELATED", 9.0, 2), ("u", "b", "RELATED", 0.2, 3), ("u", "c", "RELATED", -1.0, None), ("u", "d", "RELATED", 0.5, None), ("u", "d", "RELATED", 0.6, 7), ("u", None, "RELATED", 0.5, 1), ("u", "e", "RELATED", None, 1)],
        "user_label string, target string, relation string, weight double, at int",
    )
    out = U.with_own_edges(edges, own)
    assert rows(out, "target", "weight") == [("a", 0.4), ("b", 2.0), ("c", 0.01), ("d", 0.6)]
    assert rows(U.with_own_edges(edges, own.limit(0)), "target") == [("a",)]


def test_cold_state(spark):
    users = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "user_label string")
    counted = spark.createDataFrame([("a", 5)], "user_label string, queries long")
    personal = spark.range(1001).select(F.lit("b").alias("user_label"))
    out = U.cold_state(users, counted, personal)
    assert rows(out, "user_label", "queries", "cold", "factor", "estimated") == [("a", 5, True, 0.25, False), ("b", 2, True, 0.1, True), ("c", 0, True, 0.0, True)]
    assert rows(U.cold_state(users, counted, personal, 10).filter("user_label = 'b'"), "queries", "cold", "factor") == [(100, False, 1.0)]


def test_upgrade_in_domains(spark):
    pool = spark.createDataFrame([("x", "y", "IS_A", 1, [], "pending"), ("y", "z", "IS_A", 2, [], "pending"), ("z", "w", "IS_A", 1, [], "cooled"), ("q", "q", "IS_A", 1, [], "pending")], POOL)
    seeds = spark.createDataFrame([("x", "law"), ("y", "tax law"), ("z", "sea"), ("w", "sea"), ("q", None)], "label string, domain string")
    edges = spark.createDataFrame([("x", "y", "IS_A", 0.9)], EDGE)

    def upgraded(*names):
        e, p = L.upgrade_in_domains(edges, pool, seeds, spark.createDataFrame([(n,) for n in names], "domain string"))
        assert p.count() == 4
        return [r[0] for r in rows(p.filter("status = 'upgraded'"), "source")], rows(e, "source", "weight")

    assert upgraded("law") == (["x"], [("x", 0.9)])  # its own name is there, so parts of names are not asked
    assert upgraded("tax") == (["x", "y"], [("x", 0.9), ("y", 0.05)])
    assert upgraded("sea") == (["y"], [("x", 0.9), ("y", 0.05)])  # what was cooled stays so
    assert upgraded("", None, "%") == ([], [("x", 0.9)])


def test_submit_external(spark):
    pool = spark.createDataFrame([("a", "law", "DEFINED_AS", 2, ["u"], "pending"), ("a", "law", "IS_A", 1, ["u"], "pending"), ("b", "law", "DEFINED_AS", 9, ["u"], "upgraded")], POOL)
    found = spark.createDataFrame([("a", "law"), ("b", "law"), ("c", "law"), ("c", "law"), (None, "law"), ("d", None)], "label string, domain string")
    out = rows(L.submit_external(pool, found), "source", "relation", "count", "contributors", "status")
    assert out == [("a", "DEFINED_AS", 3, ["u"], "pending"), ("a", "IS_A", 1, ["u"], "pending"), ("b", "DEFINED_AS", 10, ["u"], "upgraded"), ("c", "DEFINED_AS", 2, ["system:curiosity"], "pending")]
    assert L.submit_external(pool, found.limit(0)).count() == 3


def test_append_aliases(spark):
    seeds = spark.createDataFrame([("a", ["k"], 1), ("b", None, 2), ("c", None, 3)], "label string, aliases array<string>, `x.y` int")
    said = spark.createDataFrame([("m", "a", "aliased"), ("k", "a", "aliased"), ("l", "a", "aliased"), ("l", "a", "aliased"), ("n", "b", "aliased"), ("o", "b", "low"), ("p", "gone", "aliased")], "keyword string, seed string, decision string")
    out, done = L.append_aliases(seeds, said)
    assert rows(out, "label", "aliases", "`x.y`") == [("a", ["k", "l", "m"], 1), ("b", ["n"], 2), ("c", None, 3)]
    assert rows(done, "keyword", "seed") == [("k", "a"), ("l", "a"), ("m", "a"), ("n", "b")]


def test_system_values(spark):
    seeds = spark.createDataFrame([("CONCEPT", "2024-01-02 10:00:00"), ("CONCEPT", "2023-01-01 00:00:00"), ("USER", None), ("META", "2024-01-02 10:00:00")], "type string, t string").select("type", F.col("t").cast("timestamp_ntz").alias("created_at"))
    edges = spark.createDataFrame([("a", "b", "IS_A", 0.1), ("meta:x", "b", "IS_A", 0.1)], EDGE)
    log = spark.createDataFrame([(0.5, 1, "2024-01-02 10:00:00"), (0.25, 0, "2024-01-01 12:00:01"), (0.9, 1, "2024-01-01 12:00:00")], "confidence double, direction int, t string").select("confidence", "direction", F.col("t").cast("timestamp_ntz").alias("created_at"))
    at = F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")
    want = {"system_total_nodes": 3.0, "system_total_edges": 1.0, "system_avg_confidence": 0.375, "system_distillation_rate": 1.0, "system_seed_growth_rate": 1.0}
    now = M.system_values(seeds, edges, log, at)
    assert dict(rows(now, "metric", "value")) == want
    assert set(dict(rows(M.system_values(seeds.limit(0), edges.limit(0), log.limit(0), at), "metric", "value")).values()) == {0.0}
    before = spark.createDataFrame([("system_total_nodes", 2.0)], "metric string, value double")
    assert dict(rows(M.system_metrics(now, before), "metric", "change"))["system_total_nodes"] == 1.0
    assert dict(rows(M.system_metrics(now, before.limit(0)), "metric", "change")) == want  # what was not there was 0


@pytest.mark.parametrize(("value", "most", "want"), [(0.0, 1.0, 0.0), (1.0, 1.0, 1.0), (1.1, 1.0, 0.3), (-0.1, 1.0, 0.3), (900.0, None, 900.0), (-1.0, None, 0.3)])
def test_clamped(value, most, want):
    assert P.clamped(value, 0.3, most) == want


def test_names_are_no_keywords(spark):
    answers = spark.createDataFrame([(1, "Physics moves the stone"), (2, None), (3, "")], "answer_id long, text string")
    known = spark.createDataFrame([("stone",)], "word string")
    names = spark.createDataFrame([("PHYSICS",), (None,)], "name string")
    assert rows(V.answer_keywords(answers, known, names), "answer_id", "word", "known") == [(1, "moves", False), (1, "stone", True)]
    assert rows(V.answer_keywords(answers, known), "word") == [("moves",), ("physics",), ("stone",)]
