"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms of a text are its character n-grams (n = 1 to 3, case kept), hashed into TERMS places, and one term for words that
repeat the word before, which counts all their n-grams. Their weight is the root of the count times the inverse document
frequency in the sample. A truncated SVD of the
sample's term-document matrix maps a term vector to a latent vector. The sample's latent vectors and labels are
broadcast (PER_LABEL rows per label, so the size is bounded by the parameters, whatever the texts' lengths: executors
count the terms, and only the counts come to the driver); for each block of documents one exact matrix product gives
all cosines, and the NEIGHBOURS nearest vote with their labels weighted by similarity.

Learning uses only rows whose crc32(doc_id as text) mod 5 is not 0. Labels, lang, source and doc_id are no inputs
of a score.

Cases: null and empty texts, and any text if there are no labels, score 0. Null labels are not learned; a null id has no
label. Repeated rows are scored each. Ties among neighbours (cosines equal to six places) go by the sample's order,
which follows hashed ids. Extra columns are kept by `score`; those named score or predicted give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.llm import _common

PER_LABEL = 1000
DIMENSIONS = 96
NEIGHBOURS = 25
THRESHOLD = 0.3
#: How strongly nearer neighbours count: votes weigh similarity to this power.
SHARPNESS = 8
#: Places that terms are hashed into.
TERMS = 2048
_MULTIPLY = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))  # fixed values: odd multipliers of a multiplicative hash


def terms(text: str | None) -> np.ndarray:
    """How often each term occurs in a whole text, TERMS long; zero if it is empty."""
    out = np.zeros(TERMS, np.int64)
    if not text:
        return out
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    h = np.zeros(len(c), np.uint32)
    for n, m in enumerate(_MULTIPLY):
        if len(c) > n:
            h = (h[: len(c) - n] + c[n:]) * m
            out += np.bincount(h >> np.uint32(21), minlength=TERMS)
    words = text.split()
    out[0] += sum(len(_MULTIPLY) * (len(a) + 1) for a, b in zip(words, words[1:]) if a == b)
    return out


@dataclass(frozen=True)
class Model:
    """idf: TERMS; projection: TERMS x DIMENSIONS; vectors: unit rows of the labelled sample; labels: 0 or 1 each."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length, in place; zero rows stay."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=x, where=norm > 0)


def _svd(x: np.ndarray, k: int) -> np.ndarray:
    """The k leading right singular vectors by subspace iteration."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], k)).astype(x.dtype)
    for _ in range(8):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    return q


def train(roots: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """The model of a sample: the roots of its term counts (a row per text) and its labels."""
    idf = np.log((1 + len(roots)) / (1 + (roots > 0).sum(0))).astype(np.float32) + np.float32(1)
    x = _unit(roots.astype(np.float32) * idf)
    q = _svd(x, min(dimensions, *x.shape))
    return Model(idf, q, _unit(x @ q), labels.astype(np.float64))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, dimensions: int = DIMENSIONS) -> Model | None:
    """Learn from at most per_label documents of each label; None without labels. docs: doc_id, text; labels: doc_id and label."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y"))
    picked = None
    for y in (0, 1):
        some = rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = some if picked is None else picked.unionAll(some)
    # 2 * per_label rows at most: a bounded broadcast, and a bounded number of texts even if ids repeat
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64("text")).limit(2 * per_label)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = [np.sqrt(terms(t.as_py())).astype("<f2").tobytes() for t in rows.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), rows.column(1)], names=["roots", "y"])

    got = sample.filter("text <> ''").select("text", "y").mapInArrow(count, "roots binary, y int").toArrow()
    if not len(got):
        return None
    roots = np.frombuffer(b"".join(got.column(0).to_pylist()), "<f2").reshape(-1, TERMS)
    return train(roots, got.column(1).to_numpy(), dimensions)


def votes(model: Model, counts: np.ndarray) -> np.ndarray:
    """Scores of texts' term counts: the share of label 1 among the nearest neighbours, weighted by similarity."""
    v = _unit(_unit(np.sqrt(counts, dtype=np.float32) * model.idf) @ model.projection)
    cos = np.round(v @ model.vectors.T, 6)
    k = min(NEIGHBOURS, cos.shape[1])
    least = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
    # of the ties at the k-th place the first ones in the sample
    near, tied = cos > least, cos == least
    near |= tied & (np.cumsum(tied, 1) <= k - near.sum(1, keepdims=True))
    w = np.where(near, np.clip(cos, 0, None), 0).astype(np.float64) ** SHARPNESS
    total = w.sum(1)
    return np.divide(w @ model.labels, total, out=np.zeros(len(w)), where=total > 0)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs (all columns, among them text) with score double and predicted int."""
    spark = docs.sparkSession
    _common.prepare(spark)
    docs = docs.drop("score", "predicted")
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    shared = spark.sparkContext.broadcast(model)
    where = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            s = np.zeros(rows.num_rows)
            for i in range(0, rows.num_rows, 250):
                texts = rows.column(where).slice(i, 250).to_pylist()
                s[i : i + 250] = votes(shared.value, np.array([terms(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.clip(s, 0, 1)), pa.array((s >= threshold).astype(np.int32))], names=[*rows.schema.names, "score", "predicted"])
        pa.default_memory_pool().release_unused()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(task, f"{schema}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels), threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
