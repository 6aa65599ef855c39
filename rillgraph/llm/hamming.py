"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit per component (1: above 0), of all its components. Codes are cut into segments of SEGMENT bits;
an index holds, per segment, the codes sorted by the segment's value. For a query the search radius per segment grows
from 0: at radius r all values that differ in r bits are looked up in every segment and new candidates are verified by
their full Hamming distance. A code at distance d differs by at most d // segments bits in some segment; so once the k-th
verified distance is below segments * (r + 1), nothing nearer can be missing and the search ends.

Rows with the same code are one entry that holds its k smallest ids, which is all that a top-k can take of it; the
reduction is a limit per group before the shuffle. Distinct codes are dealt into shards by their hash. A task builds a
shard's index once, from the rows that come first in its sorted partition, and the distinct queries stream past it; the
shards' top-k are merged.

Cases: null vectors have no code and are neither found nor queried; null and non-finite components count as 0; a vector
shorter than another counts as if zeros followed. Equal distances rank by id, null ids first. Repeated rows are found
each. Fewer than k rows give fewer results; an empty table on either side gives none. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillgraph.llm import _common

SEGMENT = 16
#: Distinct codes of a shard: at most, and at least while there are idle cores.
SHARD = 500_000
LEAST_SHARD = 8192


def codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code binary) of vectors (vec_id, embedding): the bits in order, without zero bytes at the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = []
            for x in rows.column(1):
                v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                made.append(np.packbits((v > 0) & (v < np.inf)).tobytes().rstrip(b"\0"))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(made, pa.binary())], names=["vec_id", "code"])

    rows = vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(task, "vec_id long, code binary")


@lru_cache(SEGMENT + 1)
def _masks(radius: int) -> np.ndarray:
    """All patterns of a segment with `radius` bits; made once in a worker, not for every query."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), radius)], np.int64)


def _matrix(code: list[bytes], width: int) -> np.ndarray:
    """Codes as rows of segments."""
    return np.frombuffer(b"".join(c.ljust(width, b"\0") for c in code), ">u2").reshape(-1, width // 2)


class Index:
    """Multi-index of one shard's distinct codes: rows of 16-bit segments."""

    def __init__(self, code: np.ndarray):
        self.code = code.astype(np.uint16)
        self.order, self.begin = [], []
        for s in range(code.shape[1]):
            value = self.code[:, s].astype(np.int64)
            self.order.append(np.argsort(value, kind="stable"))
            self.begin.append(np.searchsorted(value[self.order[s]], np.arange((1 << SEGMENT) + 1)))

    def search(self, query: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, distances): every code that can be among the k nearest rows; weight: rows that an entry stands for."""
        seen = np.zeros(len(self.code), bool)
        found, away = [], []
        segments = self.code.shape[1]
        for r in range(SEGMENT + 1):
            masks = _masks(r)
            new = []
            for s in range(segments):
                at = int(query[s]) ^ masks
                lo, n = self.begin[s][at], self.begin[s][at + 1] - self.begin[s][at]
                ends = np.cumsum(n)
                hit = self.order[s][np.arange(ends[-1]) + np.repeat(lo - ends + n, n)]
                hit = hit[~seen[hit]]
                seen[hit] = True
                new.append(hit)
            new = np.concatenate(new)
            found.append(new)
            away.append(np.bitwise_count(self.code[new] ^ query).sum(1, dtype=np.int64))
            d, got = np.concatenate(away), np.concatenate(found)
            covered = d < segments * (r + 1)
            if weight[got[covered]].sum() >= k or len(got) == len(self.code):
                break
        order = np.lexsort((got, d))
        rows = np.cumsum(weight[got[order]])
        # entries at the distance where the k-th row lies may tie with it
        last = d[order][min(np.searchsorted(rows, k), len(rows) - 1)] if len(rows) else 0
        keep = order[d[order] <= last]
        return got[keep], d[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, distance: the k rows of vectors nearest to each row of queries (both vec_id, embedding).

    A query that is itself among the vectors finds itself too.
    """
    spark = vectors.sparkSession
    _common.prepare(spark)
    smallest = W.partitionBy("code").orderBy("vec_id")
    # the limit per code applies before the shuffle: a common code sends k rows per task
    few = codes(vectors).withColumn("rn", F.row_number().over(smallest)).filter(F.col("rn") <= k)
    entries, _ = _common.written(few.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("vec_id"))).alias("ids")), "codes")
    asked, _ = _common.written(codes(queries).withColumnRenamed("vec_id", "query_id"), "queries")
    size = entries.agg(F.count("*").alias("n"), F.max(F.octet_length("code")).alias("w")).first()
    wide = asked.agg(F.max(F.octet_length("code")).alias("w")).first()
    width = 2 * max(1, -(-max(size.w or 0, wide.w or 0) // 2))
    shards = max(1, -(-size.n // shard), min(spark.sparkContext.defaultParallelism, size.n // LEAST_SHARD))

    ids = entries.schema["ids"].dataType
    left = entries.select(F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), "code", "ids")
    right = asked.select("code").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "code", F.lit(None).cast(ids).alias("ids"))
    dealt = left.unionAll(right).repartition(shards, "shard").sortWithinPartitions("shard", "query")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, index, held, entry_ids, weight = None, None, [], [], np.zeros(0, np.int64)
        for rows in batches:
            out: list[list] = [[], [], []]
            for mine, query, code, own in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if mine != here:
                    here, index, held, entry_ids = mine, None, [], []
                if not query:
                    held.append(code)
                    entry_ids.append([i["vec_id"] for i in own])
                    continue
                if not entry_ids:
                    continue
                if index is None:
                    index, held = Index(_matrix(held, width)), []
                    weight = np.array([len(i) for i in entry_ids])
                got, d = index.search(_matrix([code], width)[0].astype(np.uint16), weight, k)
                best = sorted(((int(x), v) for e, x in zip(got, d, strict=True) for v in entry_ids[e]), key=lambda b: (b[0], b[1] is not None, b[1] or 0))[:k]
                out[0] += [code] * len(best)
                out[1] += [v for _, v in best]
                out[2] += [x for x, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["code", "vec_id", "distance"])

    found = dealt.mapInArrow(task, "code binary, vec_id long, distance int")
    rank = F.row_number().over(W.partitionBy("code").orderBy("distance", "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return asked.join(best, "code").select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "distance")
