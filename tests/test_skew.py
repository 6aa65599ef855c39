"""Joins whose work is split: many keywords in texts, and the newest value before a time, against brute force."""

import datetime
import random

from pyspark.sql import functions as F

from rillgraph.operators import events as E
from rillgraph.operators import graph as G


def test_many_keywords_in_texts(spark):
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abc日%_") for _ in range(rng.randint(0, most)))
    texts = [(i, word(40)) for i in range(60)] + [(60, None), (61, ""), (62, "abc"), (63, "abc"), (64, "ab" * 5000)]
    words = sorted({word(5) for _ in range(80)} | {"abc", "ab" * 30, ""})
    rows = spark.createDataFrame(texts, "id long, `a.b` string").select("id", F.col("`a.b`").alias("text"), F.lit(1).alias("a.b"))
    keys = spark.createDataFrame([(w, len(w)) for w in words], "keyword string, n int")
    want = sorted((i, w, len(w)) for i, t in texts if t for w in words if w and w in t)
    for few in (0, 1000):
        out = G.holding(rows, "text", keys, few)
        assert out.columns == ["id", "text", "a.b", "keyword", "n"]
        assert sorted(tuple(r) for r in out.select("id", "keyword", "n").collect()) == want


def test_as_of_join_over_hours_and_a_hot_key(spark):
    rng = random.Random(3)
    base = datetime.datetime(2024, 1, 1)
    time = lambda: base + datetime.timedelta(minutes=rng.randint(0, 6000))
    keys = ["hot"] * 8 + ["a", "b", None]
    left = [(rng.choice(keys), time(), i) for i in range(300)] + [("hot", None, 300), ("only-left", base, 301), ("hot", base - datetime.timedelta(days=9), 302)]
    right = [(rng.choice(keys), time(), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(80)] + [("hot", None, 9.0), ("only-right", base, 5.0)]
    right += [("hot", t, v + 4) for k, t, v in right[:40] if k == "hot" and v]  # ties: the greatest value counts

    def newest(k, t):
        met = [(s, v) for j, s, v in right if k is not None and t is not None and j == k and s is not None and s <= t and v is not None]
        return max(met)[1] if met else None

    got = E.as_of_join(spark.createDataFrame(left, "key string, ts timestamp_ntz, id long"), spark.createDataFrame(right, "key string, ts timestamp_ntz, value double"))
    assert dict(tuple(r) for r in got.collect()) == {i: newest(k, t) for k, t, i in left} and got.count() == len(left)
    assert E.as_of_join(spark.createDataFrame(left, "key string, ts timestamp_ntz, id long"), spark.createDataFrame([], "key string, ts timestamp_ntz, value double")).filter("value is not null").count() == 0
