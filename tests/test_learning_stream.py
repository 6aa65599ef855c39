"""Batches of verdicts, repeated and interrupted ones among them, against one batch over all."""

import random
import time

import pytest

from rillgraph.sources.versions import Versions
from rillgraph.streaming import learning as L

EDGES = "source string, target string, relation string, weight double"


def verdicts(seed, n=150):
    rnd = random.Random(seed)
    user = lambda: rnd.choice(["u1", "u2", "u3", None])
    return [(i, user(), rnd.choice([1, 1, -1, 0]), f"n{rnd.randint(0, 6)}", f"m{rnd.randint(0, 4)}", rnd.choice(["RELATED", "SYNONYM", "IS_A"])) for i in range(n)]


def tables(memory):
    return {
        "layer": {(r.source, r.target, r.relation): round(r.weight, 6) for r in memory.layer.read().collect()},
        "personal": {(r.user_label, r.source, r.target, r.relation): round(r.weight, 6) for r in memory.personal.read().collect()},
        "pool": {(r.source, r.target, r.relation): (r["count"], tuple(r.contributors), r.status) for r in memory.pool.read().collect()},
    }


def brute(rows, edges):
    """Row by row, as the rules say."""
    layer, personal, pool = {e[:3]: e[3] for e in edges}, {}, {}
    clip = lambda x: max(0.01, min(2.0, x))
    raised = set()
    for _, user, d, *edge in rows:
        if not d:
            continue
        key = tuple(edge)
        if user is None:
            layer[key] = clip(layer.get(key, 0.5) + 0.01 * d)
            continue
        personal[(user, *key)] = clip(personal.get((user, *key), 0.5) + 0.01 * d)
        key = (*key[:2], "RELATED") if key[2] == "SYNONYM" else key
        n, users = pool.get(key, (0, set()))
        pool[key] = (n + 1, users | {user})
        if n + 1 >= 3:
            raised.add(key)
    for key in raised:
        layer[key] = max(layer.get(key, 0.0), 0.05)
    return {"layer": {k: round(v, 6) for k, v in layer.items()}, "personal": {k: round(v, 6) for k, v in personal.items()}, "pool": {k: (n, tuple(sorted(u)), "upgraded" if n >= 3 else "pending") for k, (n, u) in pool.items()}}


@pytest.fixture
def memory(spark, tmp_path):
    m = L.Memory(spark, f"file://{tmp_path}/memory")
    m.start(spark.createDataFrame(START, EDGES), spark.createDataFrame([], "user_label string, " + EDGES))
    return m


# every edge that nobody's verdicts touch is there from the start: a new one begins at .5 or, when the pool makes it first, at .05
START = [(f"n{i}", f"m{j}", r, 0.9) for i in range(7) for j in range(5) for r in ("RELATED", "SYNONYM", "IS_A")]


def test_batches(spark, memory):
    """Three batches, two of them run twice, give what row by row gives."""
    rows = verdicts(1)
    for n in (1, 2, 2, 3, 1):
        memory.apply(spark.createDataFrame(rows[(n - 1) * 50 : n * 50], L.VERDICT), n)
    assert tables(memory) == brute(rows, START)
    assert memory.pool.numbers() == [0, 1, 2, 3]


@pytest.mark.parametrize("dies", ["personal", "pool", "layer"])
def test_interrupted(spark, memory, monkeypatch, dies):
    """A batch that dies before any of its three commits is completed by running it again."""
    rows = verdicts(2, 60)
    memory.apply(spark.createDataFrame(rows[:30], L.VERDICT), 1)
    real, fragile = Versions._commit, getattr(memory, dies)

    def commit(self, version):
        if self is fragile:
            raise OSError("lost")
        return real(self, version)

    batch = spark.createDataFrame(rows[30:], L.VERDICT)
    monkeypatch.setattr(Versions, "_commit", commit)
    with pytest.raises(OSError):
        memory.apply(batch, 2)
    assert fragile.numbers() == [0, 1]
    monkeypatch.setattr(Versions, "_commit", real)
    memory.apply(batch, 2)
    assert tables(memory) == brute(rows, START)


def test_stream(spark, memory, tmp_path):
    """A stream with a restart, then one with periodic triggers that is stopped."""
    rows = verdicts(3, 120)
    folder = f"file://{tmp_path}/in"

    def put(lo, hi):
        spark.createDataFrame(rows[lo:hi], L.VERDICT).coalesce(2).write.mode("append").parquet(folder)

    def stream():
        return spark.readStream.schema(L.VERDICT).parquet(folder)

    for lo in (0, 40):
        put(lo, lo + 40)
        L.learn_into(stream(), memory, f"file://{tmp_path}/progress").awaitTermination()
    assert memory.layer.numbers() == [0, 1, 2]
    query = L.learn_into(stream(), memory, f"file://{tmp_path}/progress", every="1 second")
    put(80, 120)
    end = time.time() + 120
    while memory.layer.numbers()[-1] < 3 and time.time() < end:
        time.sleep(1)
    query.processAllAvailable()
    query.stop()
    assert tables(memory) == brute(rows, START)
