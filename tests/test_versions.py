"""A table as a log of versions."""

import pytest
from pyspark.sql import functions as F

from rillgraph.sources.versions import GONE, Versions

ROW = "source string, target string, weight double"


def rows(df):
    return sorted(map(tuple, df.select("source", "target", "weight").collect()))


@pytest.fixture
def log(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/edges", ["source", "target"], compact_after=3)


def df(spark, data):
    return spark.createDataFrame(data, ROW)


def test_versions(spark, log):
    """Changes replace, add and remove rows by key; every version stays readable; a rollback moves no data."""
    assert log.numbers() == []
    with pytest.raises(LookupError):
        log.read()
    assert log.write(df(spark, [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 3.0)]), note="first")
    assert log.change(df(spark, [("a", "b", 1.5), ("x", "y", 9.0)]))
    assert log.change(df(spark, [("b", "c", 0.0), ("a", "b", 1.7)]).withColumn(GONE, F.col("source") == "b"))
    want = {1: [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 3.0)], 2: [("a", "b", 1.5), ("b", "c", 2.0), ("c", "d", 3.0), ("x", "y", 9.0)], 3: [("a", "b", 1.7), ("c", "d", 3.0), ("x", "y", 9.0)]}
    assert {n: rows(log.read(n)) for n in log.numbers()} == want and rows(log.read()) == want[3]
    read = {f.split("/data/")[1].split("/")[0] for f in log.read(1).inputFiles()}
    assert len(read) == 1, "an old version opens its own files only"
    assert log.rollback(1, why="test")
    v = log.version()
    assert rows(log.read()) == want[1] and (v.number, v.base, v.deltas) == (4, log.version(1).base, ()) and v.meta == {"rollback_to": 1, "before": 3, "why": "test"}
    assert rows(log.read(v.meta["before"])) == want[3]
    assert log.restore(3, spark.createDataFrame([("b", "c"), ("x", "y"), ("never", "there")], "source string, target string"))
    assert rows(log.read()) == [("a", "b", 1.0), ("c", "d", 3.0), ("x", "y", 9.0)]
    assert [(r.number, r.deltas) for r in log.history().orderBy("number").collect()] == [(1, 0), (2, 1), (3, 2), (4, 0), (5, 1)]


def test_commit_once(spark, log):
    """A number is committed once; what was written for a taken one, or not committed at all, counts for nothing."""
    assert log.write(df(spark, [("a", "b", 1.0)]), 7)
    assert not log.write(df(spark, [("a", "b", 2.0)]), 7) and not log.change(df(spark, [("a", "b", 3.0)]), 7)
    assert not log._commit(log.version(7))
    assert rows(log.read()) == [("a", "b", 1.0)]
    df(spark, [("lost", "lost", 0.0)]).write.parquet(log._data())  # a crash between writing and committing
    assert rows(log.read()) == [("a", "b", 1.0)] and log.numbers() == [7]
    assert log.vacuum(1) == 1 and rows(log.read()) == [("a", "b", 1.0)]


def test_compaction(spark, log):
    """After compact_after deltas a version is written whole; compacting changes no row; vacuum keeps what is named."""
    log.write(df(spark, [("k", str(i), 0.0) for i in range(5)]))
    for i in range(1, 6):
        log.change(df(spark, [("k", str(i % 5), float(i)), ("new", str(i), float(i))]))
    assert [len(log.version(n).deltas) for n in log.numbers()] == [0, 1, 2, 3, 0, 1]
    want = rows(log.read())
    assert want == [("k", "0", 5.0), ("k", "1", 1.0), ("k", "2", 2.0), ("k", "3", 3.0), ("k", "4", 4.0)] + [("new", str(i), float(i)) for i in range(1, 6)]
    assert log.compact() and rows(log.read()) == want and log.version().deltas == ()
    assert log.vacuum(2) == 4 and rows(log.read()) == want and rows(log.read(6)) == want and log.numbers() == [6, 7]
