"""What the findings of round 4 named, each by a small case that failed before."""

import json
import random

from rillgraph.operators import learning as L
from rillgraph.operators import ripple as R
from rillgraph.operators import verify as V
from rillgraph.plans import text_queries as Q


def test_a_pool_is_made_once_for_both_ends_of_its_candidates(spark):
    """Either end counts, a candidate with both comes once; nodes that are listed twice or have no label change nothing."""
    edges = [("a", "b", 1, "pending"), ("b", "x", 2, "pending"), ("x", "a", 1, "pending"), ("x", "y", 1, "pending"), ("a", "y", 3, "upgraded"), (None, "y", 1, "pending")]
    rows = [(s, t, "R", n, state) for s, t, n, state in edges]
    pool = spark.createDataFrame(rows, "source string, target string, relation string, count long, status string")
    nodes = spark.createDataFrame([("a", "D"), ("a", "D"), ("b", "D"), ("x", "E"), (None, "D"), ("y", None)], "label string, domain string")
    got = L.pool_in_domain(pool, nodes, "D")
    assert got.columns == ["source", "target", "relation", "count"]
    assert sorted(map(tuple, got.collect())) == [("a", "b", "R", 1), ("b", "x", "R", 2), ("x", "a", "R", 1)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("status#") == pool.filter("status = 'pending'").select("source")._jdf.queryExecution().optimizedPlan().toString().count("status#")


def _graph(spark):
    rng = random.Random(7)
    names = [f"n{i}" for i in range(40)] + ["meta:m"]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(160)})
    edges = [(a, b, "R", rng.choice([0.3, 0.5, 0.7, 1.9])) for a, b in pairs if a != b] + [("n1", "n2", "S", 0.4), ("meta:m", "n3", "R", 0.7), ("odd", "n1", "R", 0.5)]
    matched = [(q, rng.choice(names)) for q in range(15) for _ in range(4)] + [(70, n) for n in names] + [(99, "nowhere"), (99, "meta:m"), (98, "odd"), (97, None)]
    nodes = [(n, rng.choice(["d", "e", "", None]), rng.choice([None, "", "what it is " * 30])) for n in names]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    return frame(matched, "query_id long, label string"), frame(edges, "source string, target string, relation string, weight double"), frame(nodes, "label string, domain string, definition string")


def test_answers_of_one_pass_are_those_of_the_log(spark):
    """Ranks, sums and counts made where a query's rows are: the same texts and objects as from state and paths."""
    matched, edges, nodes = _graph(spark)
    run = R.ripple(matched, edges, 1)
    scores = R.domain_scores(run.activated, nodes)
    best = R.top_paths(run.paths)
    made = R.regions(R.first_wave(matched, edges, nodes, 100))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(V.rendered(made)) == rows(V.render_answers(scores.filter("score >= 0.3"), R.top_seeds(run.activated), nodes, best))
    want = V.answers_json(run.activated, scores, nodes, best, matched.distinct())
    assert {q: json.loads(t) for q, t in V.rendered_json(made).collect()} == {q: json.loads(t) for q, t in want.collect()}


def test_answers_send_their_rows_to_the_queries_once(spark, sf):
    """One deal by query and no log in files: what several shuffles of the whole state and of the paths took on disk."""
    for query in (Q.answer_text, Q.answer_json):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(query_id") <= 1
        assert "ripple-paths" not in plan


def test_users_state_needs_no_log(spark):
    """Own nodes that are matched too, own edges to matched nodes and to the user, queries without user or match: as from the log."""
    matched, edges, _ = _graph(spark)
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    more = [("u1", "n1", "R", 0.8), ("u1", "n2", "R", 0.6), ("u2", "n5", "R", 1.9), ("u2", "u2", "S", 0.3), ("n3", "u1", "R", 0.7)]
    edges = edges.unionAll(frame(more, edges.schema))
    matched = matched.unionAll(frame([(3, "u1"), (4, "n1")], matched.schema))
    users = frame([(q, f"u{q % 3}") for q in range(12)] + [(200, "u1"), (97, "u2")], "query_id long, user_label string")
    rng = random.Random(2)
    own = [(f"u{rng.randrange(3)}", e.source, e.target, e.relation, rng.choice([0.2, 0.9, 2.0])) for e in edges.sample(0.6, seed=1).collect()]
    personal = frame([("u1", "u1", "n1", "R", 2.0), *own], "user_label string, source string, target string, relation string, weight double").dropDuplicates(["user_label", "source", "target", "relation"])
    cold = frame([("u1", 0.25), ("u2", 1.0)], "user_label string, factor double")
    want = R.ripple(matched, edges, 1, users, personal, cold).activated
    got = R.activated_for_users(matched, edges, users, personal, cold, 100)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    plan = got._jdf.queryExecution().toString()
    assert "ripple-start" not in plan and "ripple-paths" not in plan
