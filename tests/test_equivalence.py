"""Equivalent candidates against a direct computation, in the order of submission."""

import random

from rillgraph.operators import equivalence as Q

EDGE = "source string, target string, relation string"


def jaccard(a, b):
    return (len(a & b), len(a | b)) if a or b else (0, 1)


def test_similar_sets(spark):
    rnd = random.Random(2)
    sets = {f"s{i}": {f"t{min(rnd.randint(0, 30), rnd.randint(0, 30))}" for _ in range(rnd.randint(1, 9))} for i in range(200)}
    sets["hub"] = {f"t{i}" for i in range(31)}
    rows = spark.createDataFrame([(k, t) for k, v in sets.items() for t in v], "label string, other string")
    for threshold in (0.4, 0.75):
        got = {tuple(sorted((r.a, r.b))): (r.shared, r.union) for r in Q.similar_sets(rows, threshold).collect()}
        names = sorted(sets)
        want = {(a, b): jaccard(sets[a], sets[b]) for i, a in enumerate(names) for b in names[i + 1 :]}
        assert got == {k: v for k, v in want.items() if 100 * v[0] > round(threshold * 100) * v[1]}


def test_leaders(spark):
    rnd = random.Random(3)
    links = {(a, b) for a, b in ((rnd.randint(0, 79), rnd.randint(0, 79)) for _ in range(120)) if a > b} | {(i + 1, i) for i in range(100, 112)}
    got = {r.key: r.leader for r in Q.leaders(spark.createDataFrame(sorted(links), "later int, earlier int")).collect()}
    want = {}
    for k in sorted({x for pair in links for x in pair}):
        near = [b for a, b in links if a == k and want[b] == b]
        want[k] = min(near, default=k)
    assert got == want
    assert Q.leaders(spark.createDataFrame([], "later int, earlier int")).count() == 0


def brute(rows, aliases, edges, threshold):
    near = {}
    for s, t, *_ in edges:
        near.setdefault(s, set()).add(t)
        near.setdefault(t, set()).add(s)
    of = lambda x: near.get(x, set())
    first, users = {}, {}
    for user, s, t, r, at in rows:
        key = (aliases.get(s, s), aliases.get(t, t), Q.SAME_RELATION.get(r, r))
        first[key] = min(at, first.get(key, at))
        users.setdefault(key, []).append(user)
    leads, chosen = [], {}
    for key in sorted(first, key=lambda k: (first[k], k)):
        for other in leads:
            a, b = jaccard(of(key[0]), of(other[0])), jaccard(of(key[1]), of(other[1]))
            if 100 * a[0] * b[0] > round(threshold * 100) * a[1] * b[1]:
                chosen[key] = other
                break
        else:
            leads.append(key)
            chosen[key] = key
    out = {}
    for key, lead in chosen.items():
        n, names, m = out.get(lead, (0, set(), 0))
        out[lead] = (n + len(users[key]), names | set(users[key]), m + 1)
    return {(*k, n, tuple(sorted(names)), m, "upgraded" if n >= 3 else "pending") for k, (n, names, m) in out.items()}


def test_merged_pool(spark):
    """200 candidates among nodes of which many have similar, some the same, and some no neighbours; aliases and equivalent relations."""
    rnd = random.Random(4)
    nodes = [f"n{i}" for i in range(60)]
    edges = []
    for i, n in enumerate(nodes[:50]):
        base = (i // 5) * 4
        edges += [(n, f"h{base + k}", "RELATED") for k in range(4) if rnd.random() < 0.8] + [(f"h{rnd.randint(0, 40)}", n, "HAS")] * (rnd.random() < 0.4)
    edges += [(nodes[i], "h1", "IS_A") for i in (3, 4)] * 2
    relations = ["RELATED", "SYNONYM", "TREATS", "HELPS", "USED_FOR", "IS_A"]
    aliases = {"alias1": "n1", "alias2": "n7"}
    rows = [(f"u{rnd.randint(0, 5)}", rnd.choice(nodes + list(aliases)), rnd.choice(nodes), rnd.choice(relations), rnd.randint(0, 90)) for _ in range(260)]
    got = Q.merged_pool(
        spark.createDataFrame(rows, f"user_label string, {EDGE}, at int"), spark.createDataFrame(edges, EDGE), spark.createDataFrame([*aliases.items(), ("alias1", "n9")], "alias string, label string")
    )
    got = {(r.source, r.target, r.relation, r["count"], tuple(r.contributors), r.merged, r.status) for r in got.collect()}
    assert got == brute(rows, aliases, edges, 0.4)
    assert max(x[5] for x in got) >= 4 and sum(x[5] > 1 for x in got) > 10
