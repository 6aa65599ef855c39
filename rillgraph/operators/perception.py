"""Perception nodes: presets, activations from features, alignment of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.functions.columns import prefixed

# Preset perception nodes with their channel and threshold.
PRESETS = (
    ("percept:visual:red", "visual", 0.3), ("percept:visual:green", "visual", 0.3), ("percept:visual:blue", "visual", 0.3),
    ("percept:visual:bright", "visual", 0.7), ("percept:visual:dark", "visual", 0.3), ("percept:visual:edge_dense", "visual", 0.4),
    ("percept:auditory:high_freq", "auditory", 500.0), ("percept:auditory:low_freq", "auditory", 200.0), ("percept:auditory:bright_sound", "auditory", 3000.0),
    ("percept:auditory:dark_sound", "auditory", 1500.0), ("percept:auditory:percussive", "auditory", 0.5),
    ("percept:somatic:high_temp", "somatic", 70.0), ("percept:somatic:high_memory", "somatic", 80.0), ("percept:somatic:slow_response", "somatic", 300.0),
    ("percept:somatic:low_temp", "somatic", 50.0), ("percept:somatic:low_memory", "somatic", 30.0),
)


def presets(spark: SparkSession) -> DataFrame:
    """label, channel, threshold of the preset nodes."""
    return spark.createDataFrame(list(PRESETS), "label string, channel string, threshold double")


def custom_nodes(rows: DataFrame) -> DataFrame:
    """label, channel, valid: labels with their prefix; valid if the label names its channel."""
    label = prefixed(F.col("label"), "percept:")
    return rows.select(label.alias("label"), "channel", (F.element_at(F.split(label, ":"), 2) == F.col("channel")).alias("valid"))


def _fired(frame: str, rules: list[tuple[str, Column, Column]]) -> list[Column]:
    found = F.array(*(F.when(when, F.struct(F.lit(label).alias("seed"), value.alias("activation"))) for label, when, value in rules))
    return [F.col(frame), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")]


def _out(df: DataFrame, frame: str, rules: list) -> DataFrame:
    return df.select(*_fired(frame, rules)).select(frame, "a.seed", F.least(F.lit(1.0), F.col("a.activation")).alias("activation"))


def _at(seed: str) -> float:
    """The preset threshold of a node."""
    return next(t for label, _, t in PRESETS if label == f"percept:{seed}")


def clamped(value: float, default: float, most: float | None = 1.0) -> float:
    """A configured threshold, or the default where it is below 0 or above `most` (None: no upper bound)."""
    return value if value >= 0 and (most is None or value <= most) else default


def visual(features: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """frame_id, seed, activation of red, green, blue, brightness and edges beyond their thresholds.

    thresholds: other ones by the node's last name (red, green, blue, bright, dark, edge_dense); one outside of 0 to 1 does not count.
    """

    def at(name: str) -> float:
        default = _at(f"visual:{name}")
        return clamped((thresholds or {}).get(name, default), default)

    r = [(f"percept:visual:{c}", F.col(c) > at(c), F.col(c)) for c in ("red", "green", "blue")]
    light, edges = F.col("brightness"), F.col("edges")
    r += [("percept:visual:bright", light > at("bright"), light), ("percept:visual:dark", light < at("dark"), 1 - light), ("percept:visual:edge_dense", edges > at("edge_dense"), edges)]
    return _out(features, "frame_id", r)


def auditory(features: DataFrame, high: float = 500.0, low: float = 200.0, bright: float = 3000.0) -> DataFrame:
    """frame_id, seed, activation of dominant frequency, centroid and percussion. Thresholds below 0 do not count: the presets do."""
    high, low, bright = (clamped(v, _at(f"auditory:{n}"), None) for v, n in ((high, "high_freq"), (low, "low_freq"), (bright, "bright_sound")))
    f, c = F.col("dominant"), F.col("centroid")
    rules = [
        ("percept:auditory:high_freq", f > high, f / 1000), ("percept:auditory:low_freq", (f < low) & (f > 0), (low - f) / low), ("percept:auditory:bright_sound", c > bright, c / 10000),
        ("percept:auditory:dark_sound", (c < bright / 2) & (c > 0), c / bright), ("percept:auditory:percussive", F.col("percussive"), F.lit(0.8)),
    ]
    return _out(features, "frame_id", rules)


def somatic(features: DataFrame, temp: float = 70.0, memory: float = 80.0, slow: float = 300.0) -> DataFrame:
    """frame_id, seed, activation of temperature, memory and latency; impossible readings are dropped."""
    t = F.when(F.col("cpu_temp").between(0, 150), F.col("cpu_temp"))
    m = F.when(F.col("memory_percent").between(0, 100), F.col("memory_percent"))
    d = F.col("latency_ms")
    rules = [
        ("percept:somatic:high_temp", t > temp, (t - temp) / 30), ("percept:somatic:low_temp", t < temp - 20, (temp - 20 - t) / 20), ("percept:somatic:high_memory", m > memory, (m - memory) / 20),
        ("percept:somatic:low_memory", m < memory - 30, (memory - 30 - m) / 30), ("percept:somatic:slow_response", d > slow, (d - slow) / slow),
    ]
    return _out(features, "frame_id", rules)


def strategy(domains: DataFrame, external: bool = False) -> DataFrame:
    """domain, strategy from counts (domain, seeds, edges, pending): internal, candidate_upgrade, external or none."""
    inside = (F.col("seeds") > 0) & (F.col("edges") > 0)
    return domains.select("domain", F.when(inside, "internal").when(F.col("pending") > 0, "candidate_upgrade").when(F.lit(external), "external").otherwise("none").alias("strategy"))


def aligned(vectors: DataFrame, threshold: float = 0.3, block: int = 1024) -> DataFrame:
    """id, n, best, similarity: of each vector (id, label, x array<double>) with others of its label above the threshold, how many, and the nearest.

    A label's vectors are cut into blocks, and each pair of blocks is one task's product; a block goes to as many tasks
    as its label has blocks. Null and zero vectors have no cosine; lengths of a label agree.
    """
    size = vectors.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = vectors.filter(F.exists("x", lambda v: v != 0)).join(size, "label").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("label", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "x")

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ids, own = pdf["id"].to_numpy(), pdf["own"].to_numpy()
        x = np.stack(pdf["x"].to_list())
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        cos = x @ x.T
        ok = (cos > threshold) & (ids[:, None] != ids[None, :])
        if pdf["a"].iloc[0] != pdf["b"].iloc[0]:
            ok &= own[:, None] != own[None, :]
        near = np.where(ok, np.round(cos, 6), -2.0)
        best = near.argmax(1)  # the smallest id of equal ones
        use = ok.any(1)
        return pd.DataFrame({"id": ids[use], "n": ok.sum(1)[use], "best": ids[best][use], "similarity": near.max(1)[use]})

    found = rows.groupBy("label", "a", "b").applyInPandas(unit, "id long, n long, best long, similarity double")
    nearest = F.max(F.struct("similarity", (-F.col("best")).alias("b")))
    return found.groupBy("id").agg(F.sum("n").alias("n"), nearest.alias("m")).select("id", "n", (-F.col("m.b")).alias("best"), "m.similarity")
