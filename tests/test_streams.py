"""Streams over several triggers and restarts against the batch, and their state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rillgraph.operators import events as E
from rillgraph.streaming import limits as L

DAY = datetime.datetime(2024, 1, 1)
CALLS = "event_id long, key string, ts timestamp, failed boolean"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, rows, folder):
    spark.createDataFrame(rows, CALLS).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, folder, rule, kept, late="30 seconds"):
    """One run over what is there; a later call with the same folder goes on where this one ended."""
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = L.judged(stream, rule, late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    kept += q.recentProgress
    return q


def calls(seed, n=240):
    """Calls a second or so apart of a few keys, each at most 20 seconds out of order."""
    rnd = random.Random(seed)
    rows = [(i, f"k{rnd.randint(0, 4)}", DAY + datetime.timedelta(seconds=i * 2 + rnd.choice([0, 0, 0.5]) - rnd.randint(0, 10)), rnd.choice([True, True, False, None])) for i in range(n)]
    return rows


@pytest.mark.parametrize("name", ["window", "breaker"])
def test_judged(rocks, tmp_path, name):
    """Four triggers and a restart between them give what the batch gives; idle keys leave the state."""
    rows = calls(1)
    rule = L.Window(3, 20) if name == "window" else L.Breaker(3, 15)
    progress = []
    for part in range(4):
        put(rocks, rows[part * 60 : part * 60 + 60], tmp_path / "in")
        if part % 2:
            run(rocks, tmp_path, rule, progress)
    end = (-1, "end", DAY + datetime.timedelta(days=1), False)
    put(rocks, [end], tmp_path / "in")
    put(rocks, [(-2, "end", end[2] + datetime.timedelta(days=1), False)], tmp_path / "in")
    put(rocks, [(-3, "k1", DAY, False)], tmp_path / "in")  # a day late
    run(rocks, tmp_path, rule, progress)
    table = rocks.createDataFrame(rows, CALLS)
    want = E.fixed_windows(table, 3, 20) if name == "window" else E.circuit_breaker(table, 3, 15)
    got = rocks.read.parquet(str(tmp_path / "out")).filter("event_id >= 0")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    states = [s for p in progress for s in p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1
    left = rocks.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / "progress"))
    assert left.count() <= (1 if name == "window" else 6)


def test_rules():
    """Worked examples: a window ends after, not at, its width; after the reset a breaker counts from 0."""
    t = lambda s: DAY + datetime.timedelta(seconds=s)
    state, allowed = None, []
    for s in (0, 60, 60.5, 61, 62):
        state, ok = E.window_step(state, t(s), 2, 60)
        allowed.append(ok)
    assert allowed == [True, True, True, True, False]
    state, seen = None, []
    for s, failed in ((0, True), (1, True), (2, True), (3, False), (62, True), (63, True), (64, True), (64.5, True), (65, True)):
        state, name, passed = E.breaker_step(state, t(s), failed, 3, 60)
        seen.append((name, passed))
    assert seen == [("closed", True)] * 3 + [("open", False), ("open", False)] + [("closed", True)] * 3 + [("open", False)]


def test_join_state_is_bounded(spark, tmp_path):
    """Twelve hours of events an hour at a time: the state keeps the last window and the watermark's delay, late events are dropped and counted."""
    from rillgraph.streaming import binding as B

    rnd = random.Random(5)
    kinds = ["view", "click", "purchase"]
    rows = [(i, DAY + datetime.timedelta(seconds=i * 30), 1, rnd.choice(kinds), 1.0, "{}") for i in range(1440)]
    late = {i for i in range(0, 1200, 40)}
    portions = [[r for r in rows[h * 120 : h * 120 + 120] if r[0] not in late] for h in range(12)] + [[r for r in rows if r[0] in late]]
    seen = []
    got = B.joined_in_portions(spark, [spark.createDataFrame(p, B.EVENTS).coalesce(1) for p in portions], f"file://{tmp_path}", 60_000, "10 minutes", seen)
    on_time = [r for r in rows if r[0] not in late]
    want = sorted((p[0], c[0]) for p in on_time if p[3] != "purchase" for c in on_time if c[3] == "purchase" and abs((p[1] - c[1]).total_seconds()) <= 60)
    assert sorted((r.percept_id, r.concept_id) for r in got.collect()) == want
    kept = [s["numRowsTotal"] for p in seen for s in p["stateOperators"]]
    assert max(kept) <= 3 * 150 < 1440, "percepts are in three buckets each; an hour and ten minutes are 140 events"
    assert sum(s["numRowsDroppedByWatermark"] for p in seen for s in p["stateOperators"]) == sum(3 if rows[i][3] != "purchase" else 1 for i in late)
    left = B.state_rows(spark, f"file://{tmp_path}", "left").count() + B.state_rows(spark, f"file://{tmp_path}", "right").count()
    assert left <= 3 * 30


def test_rolling_quantiles(spark, tmp_path):
    """Merged sketches give, on a stream with restarts too, a value whose rank is near the quantile's; few values give it exactly."""
    import math

    from rillgraph.streaming import binding as B

    rnd = random.Random(6)
    rows = [(i, DAY + datetime.timedelta(seconds=i * 0.05), 1, "view" if i % 1000 else "rare", rnd.lognormvariate(0, 2), "{}") for i in range(20_000)]
    rows.append((-1, DAY + datetime.timedelta(seconds=30), 1, "none", None, "{}"))
    table = spark.createDataFrame(rows, B.EVENTS)
    got = {(r.event_type, r.start): (r.n, r.p99) for r in B.rolling_rates(table).collect()}
    windows = {}
    for r in rows:
        minute = r[1].replace(second=0, microsecond=0)
        for k in range(5):
            windows.setdefault((r[3], minute - datetime.timedelta(minutes=k)), []).append(r[4])
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in windows.items()}
    for (kind, start), (n, p99) in got.items():
        own = sorted(v for v in windows[kind, start] if v is not None)
        if kind == "none":
            assert p99 is None
        elif n < 200:
            assert p99 == own[math.ceil(0.99 * n) - 1]
        else:
            assert abs(own.index(p99) + 1 - 0.99 * n) <= 0.02 * n
    end = (-2, DAY + datetime.timedelta(days=1), 1, "end", 0.0, "{}")
    for part in (rows[:9000], rows[9000:], [end], [(-3, DAY + datetime.timedelta(days=2), 1, "end", 0.0, "{}")]):
        spark.createDataFrame(part, B.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = B.rolling_rates(B.events(spark, f"{tmp_path}/in", 10))
        streamed = B.run_to_end(stream, f"file://{tmp_path}")
    streamed = {(r.event_type, r.start): r.n for r in streamed.filter("event_type <> 'end'").collect()}
    assert streamed == {k: n for k, (n, _) in got.items()}
