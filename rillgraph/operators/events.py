"""Perception events: co-activation in a time window, Hebbian weights, states, rate limits, signal features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillgraph.config import CONFIG
from rillgraph.functions.columns import clip


def co_activations(percepts: DataFrame, concepts: DataFrame, window_ms: int = CONFIG.hebbian_window_ms) -> DataFrame:
    """Band join: percept (event_id, seed, ts) and concept events at most window_ms apart.

    Times fall into buckets of the window's width; a percept is posted to its bucket and both neighbours, so the join
    is on equal buckets and the exact condition filters.
    """
    ms = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1000).cast("long")
    p = percepts.select(F.col("event_id").alias("percept_id"), F.col("seed").alias("percept"), ms("ts").alias("t1")).withColumn("b", F.explode(F.array(*(F.floor(F.col("t1") / window_ms) + d for d in (-1, 0, 1)))))
    c = concepts.select(F.col("event_id").alias("concept_id"), F.col("seed").alias("concept"), ms("ts").alias("t2")).withColumn("b", F.floor(F.col("t2") / window_ms))
    return p.join(c, "b").filter(F.abs(F.col("t1") - F.col("t2")) <= window_ms).select("percept_id", "concept_id", "percept", "concept", F.abs(F.col("t1") - F.col("t2")).alias("apart_ms"))


def bindings(pairs: DataFrame) -> DataFrame:
    """percept, concept, n, weight: n sightings give clip(n * .01)."""
    out = pairs.groupBy("percept", "concept").agg(F.count("*").alias("n"))
    return out.withColumn("weight", clip(F.round(F.col("n") * CONFIG.hebbian_rate, 9)))


def decay(weights: DataFrame, seen: DataFrame) -> DataFrame:
    """Bindings after a window: those of percepts that met no concept lose .001 and go below .01."""
    met = seen.select("percept").distinct().withColumn("__met", F.lit(True))
    w = F.when(F.col("__met"), F.col("weight")).otherwise(F.round(F.col("weight") - CONFIG.hebbian_decay, 9))
    return weights.join(met, "percept", "left").withColumn("weight", w).filter(F.col("weight") >= CONFIG.weight_min).drop("__met")


def percept_state(events: DataFrame) -> DataFrame:
    """seed, activation, last_activation, activation_count: the newest value and the number of events."""
    return events.groupBy("seed").agg(F.max_by("value", F.struct("ts", "event_id")).alias("activation"), F.max("ts").alias("last_activation"), F.count("*").alias("activation_count"))


def rate_windows(events: DataFrame, limit: int = 100, width: str = "60 seconds") -> DataFrame:
    """key, start, n, blocked: events per key and tumbling window, and how many were beyond the limit."""
    out = events.groupBy("key", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("blocked"))


def _in_order(rows: DataFrame, columns: list[str], step: Callable[..., tuple], schema: str) -> DataFrame:
    """event_id and what step makes of each key's rows in order of time: step(state, ts, *columns) gives the next state and the row's values.

    A key's first state is None. Rows come sorted, one batch at a time, so a hot key takes no more memory than others;
    its rows are one task's work, as each depends on those before.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            out = []
            for k, t, e, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    key, state = k, None
                state, *made = step(state, t, *rest)
                out.append((e, *made))
            if out:
                ids, *others = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, others)], names=names)

    ordered = rows.select("key", "ts", F.col("event_id").cast("long"), *columns).repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return ordered.mapInArrow(run, schema)


def window_step(state: tuple | None, t: datetime, limit: int, seconds: float) -> tuple:
    """The next (start, n) of a client's window and whether the request at t is allowed; blocked requests count too."""
    start, n = state or (None, 0)
    if start is None or (t - start).total_seconds() > seconds:
        start, n = t, 0
    return (start, n + 1), n < limit


def breaker_step(state: tuple | None, t: datetime, failed: bool | None, failures: int, reset_seconds: float) -> tuple:
    """The next (failures, last failure, open) of a service, its state as the call at t met it, and whether the call passed."""
    bad, last, is_open = state or (0, None, False)
    if is_open:
        if (t - last).total_seconds() <= reset_seconds:
            return (bad, last, True), "open", False
        bad = 0
    bad, last = (bad + 1, t) if failed else (0, last)
    return (bad, last, bool(failed) and bad >= failures), "closed", True


def fixed_windows(events: DataFrame, limit: int = 100, seconds: int = 60) -> DataFrame:
    """event_id, allowed under windows that start at a key's first event later than `seconds` after the last start; keys are clients, each in order."""

    def step(state: tuple | None, t: datetime) -> tuple:
        return window_step(state, t, limit, seconds)

    return _in_order(events, [], step, "event_id long, allowed boolean")


def circuit_breaker(calls: DataFrame, failures: int = 5, reset_seconds: int = 60) -> DataFrame:
    """event_id, state, passed for calls (event_id, key, ts, failed): open after so many failures without a success between.

    A call later than the reset after the last failure closes it and counts from 0 again. A null outcome is a success.
    """

    def step(state: tuple | None, t: datetime, failed: bool | None) -> tuple:
        return breaker_step(state, t, failed, failures, reset_seconds)

    return _in_order(calls, ["failed"], step, "event_id long, state string, passed boolean")


def audio_features(frames: DataFrame, rate: int = 16000) -> DataFrame:
    """frame_id with dominant, centroid, bandwidth (Hz) and percussive of samples array<double>."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, s in zip(pdf["frame_id"], pdf["samples"], strict=True):
                x = np.asarray(s, float)
                power = np.abs(np.fft.rfft(x))[: len(x) // 2] if len(x) > 1 else np.zeros(1)
                f = np.arange(len(power)) * rate / max(len(x), 1)
                total = power.sum()
                centre = float((f * power).sum() / total) if total else 0.0
                width = float(np.sqrt((((f - centre) ** 2) * power).sum() / total)) if total else 0.0
                e = np.array([(h**2).sum() for h in np.array_split(x, 8)])
                out.append((i, float(f[power.argmax()]), centre, width, bool(e.mean() > 0 and np.abs(np.diff(e)).max() / e.mean() > 2)))
            yield pd.DataFrame(out, columns=["frame_id", "dominant", "centroid", "bandwidth", "percussive"])

    return frames.select("frame_id", "samples").mapInPandas(run, "frame_id long, dominant double, centroid double, bandwidth double, percussive boolean")


def visual_features(frames: DataFrame) -> DataFrame:
    """frame_id with red, green, blue (shares of the brightness), brightness and edges (share of strong Sobel responses). frames: width, height, rgb binary."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, w, h, data in zip(pdf["frame_id"], pdf["width"], pdf["height"], pdf["rgb"], strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, 3).astype(float)
                total = x.sum() or 1.0
                g = x.mean(2)
                p = [g[r : h - 2 + r, c : w - 2 + c] for r in range(3) for c in range(3)] if h > 2 and w > 2 else [np.zeros((1, 1))] * 9
                gx = p[2] + 2 * p[5] + p[8] - p[0] - 2 * p[3] - p[6]
                gy = p[6] + 2 * p[7] + p[8] - p[0] - 2 * p[1] - p[2]
                out.append((i, *(float(x[:, :, k].sum() / total) for k in range(3)), float(x.mean() / 255), float((np.abs(gx) + np.abs(gy) > 50).mean())))
            yield pd.DataFrame(out, columns=["frame_id", "red", "green", "blue", "brightness", "edges"])

    return frames.mapInPandas(run, "frame_id long, red double, green double, blue double, brightness double, edges double")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """key, start, end, n of sessions that end after a gap."""
    out = events.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def as_of_join(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """left (key, ts, id) with the newest right (key, ts, value) not after it, the greatest of equal times; null where there is none.

    The union of both sides is sorted within the hours of a key, so a hot key is many tasks' work and no band of pairs arises. What an hour
    has not seen yet is carried from the hours before: one row per key and hour. Null values on the right do not count; rows without key or
    time find nothing.
    """
    values = right.filter(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull())
    both = left.select(key, "ts", "id", F.lit(None).cast("double").alias("value"), F.lit(1).alias("side")).unionAll(values.select(key, "ts", F.lit(None).cast("long"), "value", F.lit(0)))
    both = both.withColumn("part", F.struct(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")))
    upto = W.partitionBy(key, "part").orderBy("ts", "side", "value").rowsBetween(W.unboundedPreceding, 0)
    within = both.withColumn("value", F.last("value", ignorenulls=True).over(upto)).filter("side = 1").select(key, "part", "id", "value")
    newest = both.groupBy(key, "part").agg(F.max(F.when(F.col("side") == 0, F.struct("ts", "value"))).alias("newest"))
    before = F.last("newest", ignorenulls=True).over(W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    carried = newest.select(key, "part", before.alias("carried")).filter("carried is not null")
    return within.join(carried, [key, "part"], "left").select("id", F.coalesce("value", "carried.value").alias("value"))
