"""What the findings of round 3 named, each by a small case that failed before."""

import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from rillgraph import session
from rillgraph.operators import goals as G
from rillgraph.operators import graph as G_
from rillgraph.operators import learning as L
from rillgraph.operators import lookup as K
from rillgraph.operators import ripple as R
from rillgraph.plans import learning_queries as Q
from rillgraph.plans import report_queries as reports
from rillgraph.sources import graph as S


def test_renewed_goals_are_evicted_as_the_new_ones(spark):
    """Of equal weights the longest untouched goes first; a renewed goal counts from its renewal, not from its making."""
    now = datetime.datetime(2024, 2, 1)
    old = now - datetime.timedelta(minutes=5)
    rows = [("had:renewed", now, old), ("goal_new", now, now), ("had:waiting", old, old)]
    goals = spark.createDataFrame([(i, "d", "new_term", "c", "pending", 0.6, None, touched, made) for i, touched, made in rows], "goal_id string, domain string, kind string, condition string, status string, weight double, user_label string, touched timestamp_ntz, created timestamp_ntz")
    users = spark.createDataFrame([], "user_label string, seen timestamp_ntz")
    left = G.cooled(goals, users, F.lit(now).cast("timestamp_ntz"), 1).filter("reason is null").collect()
    assert [r.goal_id for r in left] == ["had:renewed"]


def test_order_lines_are_dealt_to_tasks_that_number_as_they_do(spark, monkeypatch):
    """More lines are more tasks, not larger ones; pairs are those of a direct count, both ways round."""
    rng = random.Random(4)
    lines = [(rng.randint(1, 120), rng.choice([1, 2, 3, 4, 5, 6, None])) for _ in range(400)]
    monkeypatch.setattr(session, "ROWS_A_TASK", 20)
    got = S.cooccurrence(spark.createDataFrame(lines, "l_orderkey long, l_partkey long"))
    assert ", 20), REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()
    orders = {}
    for o, p in lines:
        orders.setdefault(o, set()).add(p)
    n = Counter((a, b) for parts in orders.values() for a in parts for b in parts if a and b and a != b)
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, b, k) for (a, b), k in n.items() if k >= 2)


def test_shuffles_begin_with_partitions_in_proportion(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    try:
        session.spread(spark, 50 * session.ROWS_A_PARTITION)
        session.spread(spark, 1)
        assert spark.conf.get(name) == "50"
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_an_index_of_labels_is_not_broadcast(spark):
    """Files of an index are small beside its rows; what words do not ask for is not written at all."""
    labels = spark.createDataFrame([("brand:alpha",), ("Omega",), (None,)], "label string")
    words = spark.createDataFrame([("LPHA",), ("me",), ("",), (None,)], "word string")
    held = K.holding(words, K.gram_index(labels))
    assert "SortMergeJoin" in held._jdf.queryExecution().executedPlan().toString()
    posted = K.postings(words, labels)
    assert {r.gram for r in posted.collect()} == {"lph", "pha", "me"}
    want = [("LPHA", "brand:alpha"), ("me", "Omega")]
    assert sorted(tuple(r) for r in held.collect()) == want == sorted(tuple(r) for r in K.holding(words, posted).collect())


def _graph(spark):
    rng = random.Random(11)
    names = [f"n{i}" for i in range(25)] + ["meta:m"]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(70)})
    edges = [(a, b, "R", rng.choice([0.3, 0.5, 0.7, 1.9])) for a, b in pairs if a != b] + [("n1", "n2", "S", 0.4), ("meta:m", "n3", "R", 0.7)]
    matched = [(q, rng.choice(names)) for q in range(12) for _ in range(3)] + [(99, "nowhere"), (99, "meta:m")]
    return spark.createDataFrame(matched, "query_id long, label string"), spark.createDataFrame(edges, "source string, target string, relation string, weight double")


def test_the_state_without_a_log_is_that_of_the_log(spark):
    """Few edges that go to the queries, or many that are met by their source: the same rows; nothing of a wave is written."""
    matched, edges = _graph(spark)
    for depth, virtual in ((0, False), (1, True), (2, False), (3, True)):
        want = sorted(map(tuple, R.ripple(matched, edges, depth, virtual=virtual).activated.collect()), key=repr)
        for few in (0, 1000):
            got = R.activated(matched, edges, depth, virtual, few=few)
            assert sorted(map(tuple, got.collect()), key=repr) == want
            assert "ripple-paths" not in got._jdf.queryExecution().toString()


def test_a_query_stays_with_its_task_where_edges_are_few(spark):
    """Only the deal of the matched nodes shuffles; two waves over edges that are broadcast do not."""
    matched, edges = _graph(spark)
    plan = R.activated(matched, edges, 2).groupBy("query_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan
    assert "SortMergeJoin" not in plan


def _ascent(label, up, domains, depth):
    """What infer_domains says of one blank node, by walking its levels."""
    seen, level = {label}, [label]
    again = False
    for hop in range(1, depth + 1):
        level = [p for x in level for p in sorted(up.get(x, ()))]
        if known := [domains[p] for p in level if domains.get(p)]:
            return min(known), "is_a", hop
        again |= len(set(level)) < len(level) or bool(seen & set(level))
        level = sorted(set(level) - seen)
        seen |= set(level)
    return "常识", "cycle" if again else "fallback", None


def test_ascents_are_those_of_a_walk_and_met_nodes_are_carried_near_forks_only(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(f"ring{i}", f"ring{(i + 1) % 7}") for i in range(7)] + [(f"tail{i}", f"tail{i + 1}" if i < 6 else "ring3") for i in range(7)]
    edges += [(f"long{i}", f"long{(i + 1) % 14}") for i in range(14)] + [("self", "self"), ("under", "self")] + [(f"chain{i}", f"chain{i + 1}") for i in range(16)]
    forked = [(f"{g}x{rng.randrange(9)}", f"{g}x{rng.randrange(9)}") for g in range(12) for _ in range(8)] + [("below1", "below0"), ("below0", "0x1")]
    domains = {"chain16": "top"} | {f"{g}x0": "d" for g in range(0, 12, 3)}

    def check(edges, depth):
        names = sorted({x for e in edges for x in e})
        up = {a: {b for x, b in edges if x == a} for a in names if not domains.get(a)}
        seeds = spark.createDataFrame([(x, domains.get(x, "")) for x in names], "label string, domain string")
        got = {r.label: (r.inferred, r.method, r.hops) for r in G_.infer_domains(seeds, spark.createDataFrame([(a, b, "IS_A") for a, b in edges], "source string, target string, relation string"), depth).collect()}
        assert got == {x: _ascent(x, up, domains, depth) for x in names if not domains.get(x)}

    check(edges + forked, 10)
    monkeypatch.setattr(G_, "_tangled", None)  # nothing is carried where nothing forks
    check(edges, 10)


def test_pairs_are_checked_where_the_query_is(spark):
    """Links that came with the waves tell what edges tell; no pair is sent to the edges, and the limits of a query hold."""
    matched, edges = _graph(spark)
    known = {frozenset((e.source, e.target)) for e in edges.collect()}
    for few in (0, 1000):
        run = R.activated(matched, edges, 2, links=True, few=few)
        rows = run.collect()
        got = G_.associations(run, reach=3, checks=9)
        want = set()
        for q in {r.query_id for r in rows}:
            order = [r.label for r in sorted((r for r in rows if r.query_id == q and r.activation >= 0.1), key=lambda r: (-r.activation, r.label))]
            pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1 : i + 4]][:9]
            want |= {(q, a, b) for a, b in pairs if frozenset((a, b)) not in known}
        assert {tuple(r) for r in got.collect()} == want
        assert {tuple(r) for r in G_.associations(run.drop("linked"), edges, reach=3, checks=9).collect()} == want


def test_learning_paths_need_no_log(spark):
    """The paths of a log of waves, parallel edges and limits included; a query without an id is one like others."""
    matched, edges = _graph(spark)
    matched = matched.unionAll(spark.createDataFrame([(None, "n1"), (None, "n2"), (5, None)], matched.schema))
    for depth, cap in ((1, 500), (2, 7), (3, 500)):
        want = sorted(map(tuple, R.learning_paths(R.ripple(matched, edges, depth).paths, cap=cap).collect()), key=repr)
        got = R.learned(matched, edges, depth, cap)
        assert sorted(map(tuple, got.collect()), key=repr) == want
        assert "ripple-paths" not in got._jdf.queryExecution().toString()


def test_the_pool_walks_reinforced_queries_over_edges_made_once(spark, sf, monkeypatch):
    """Other queries give the pool nothing, so they are not walked; the pool is that of all deltas."""
    deltas, users = Q._deltas(spark, sf)
    want = sorted(map(repr, L.pool(deltas.filter("delta > 0").join(users, "query_id")).collect()))
    assert sorted(map(repr, Q._pool(spark, sf).collect())) == want
    made, walked = [], []
    good, lines = S.table(spark, sf, "orders").filter("o_totalprice > 200000"), S.table(spark, sf, "lineitem")
    part_edges, learned = S.part_edges, R.learned
    monkeypatch.setattr(S, "part_edges", lambda *a: made.append(1) or part_edges(*a))
    monkeypatch.setattr(R, "learned", lambda matched, *a: walked.append(matched.select("query_id").distinct().count()) or learned(matched, *a))
    for query in (Q.pool_merged, Q.cooldown):
        made.clear(), walked.clear()
        query(spark, sf)
        assert len(made) == 1
        assert walked == [good.join(lines, good["o_orderkey"] == lines["l_orderkey"], "left_semi").count()]


def _first_groups(df, keys="l_"):
    """How many exchanges each of lineitem's files passes before its rows are first grouped by such keys."""
    plan, out, last = df._jdf.queryExecution().executedPlan().toString(), [], {}
    for line in plan.split("== Initial Plan ==")[0].splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        last = {d: n for d, n in last.items() if d < depth} | {depth: line.lstrip(" :+-*()0123456789")}
        if "FileScan" in line and "l_partkey" in line:
            path = [last[d] for d in sorted(last)]
            grouped = [i for i, n in enumerate(path) if f"HashAggregate(keys=[{keys}" in n]
            out += [sum("Exchange" in n for n in path[max(grouped) :])] if grouped else []
    return out


def test_lines_are_dealt_before_they_are_grouped(spark, sf):
    """No task that reads files groups them: of lines nearly each is a group of its own, and a split is larger in a larger table."""
    edges = S.edges(spark, sf)
    for df in (edges, edges.agg(F.sum("weight")), S.matched(spark, sf), S.part_edges(spark, sf), S.personal(spark, sf)):
        found = _first_groups(df)
        assert found and min(found) == 1


def test_triples_of_lines_are_dealt_before_they_are_grouped(spark, sf):
    assert _first_groups(reports.import_layer2(spark, sf), "source") == [1]


def test_a_log_is_dealt_before_its_state_is_summed(spark):
    """What waves wrote is not grouped by the tasks that read it, whose splits grow with it."""
    matched, edges = _graph(spark)
    plan = R.ripple(matched, edges, 2).activated._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Union") > plan.index("Exchange") > plan.rindex("Aggregate(")
