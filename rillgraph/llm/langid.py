"""Language identification by string kernels.

Kernel of two texts: the number of character n-grams (n = 1 to 4, lower-cased; the blended spectrum) that both
have, by presence, over the root of the product of their numbers of n-grams. Nyström landmarks map a text to its
kernel values with them, whitened by the landmarks' own kernel matrix; one-versus-rest kernel ridge regression on
these features gives a value per language. All of it is linear in the text's presence vector, so the three matrices
are multiplied once, and a block of documents is scored by one product of presence with an n-grams x languages
matrix. n-grams are hashed into BUCKETS places, which bounds the broadcast; two n-grams in one place count as one, and
a text of 3,000 n-grams has about 17 such pairs, which leaves the order of the kernel values as it is.

Learning uses text and lang of at most SALTS * PER_SALT rows per language, none whose crc32(doc_id as text)
mod 5 is 0. Executors make their n-grams; the places of these (at most 1 MB a text, 10 KB as a rule) come to the driver,
where a system of LANDMARKS rows per language is solved. lang, source and doc_id are no inputs of a prediction.

Cases: `und` with score 0 for null texts, texts without a letter, and if nothing was learned. Ties go to the
language first by code point. Repeated rows are predicted each. Extra columns are kept by `predict`; those named
lang_pred or score give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillgraph.llm import _common
from rillgraph.llm.quality import held_out

BUCKETS = 1 << 18
SALTS, PER_SALT = 16, 20
LANDMARKS = 64
RIDGE = 1e-2
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """The distinct buckets of the text's n-grams, n from 1 to 4."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    seen = np.zeros(BUCKETS, bool)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, 5):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        seen[(h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)] = True
    return np.flatnonzero(seen)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """weights: BUCKETS x languages; a text's values are the mean-scaled sum of its n-grams' rows."""

    languages: list[str]
    weights: np.ndarray


def _kernel(sets: list[np.ndarray], place: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of texts with the landmarks, whose columns of n-grams stand in place."""
    out = np.zeros((len(sets), landmarks.shape[1]))
    for i, s in enumerate(sets):
        at = place[s]
        out[i] = landmarks[at[at >= 0]].sum(0) / np.sqrt(len(s))
    return out


def train(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The model of a sample's sets of grams; landmarks are its first rows of each language in turn."""
    names = sorted(set(langs))
    if not names:
        return None
    turn: dict[str, int] = {}
    chosen = []
    for i, lang in enumerate(langs):
        turn[lang] = turn.get(lang, 0) + 1
        if turn[lang] <= landmarks:
            chosen.append(i)
    known = np.unique(np.concatenate([sets[i] for i in chosen]))
    place = np.full(BUCKETS, -1)
    place[known] = np.arange(len(known))
    p = np.zeros((len(known), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        p[place[sets[i]], j] = 1 / np.sqrt(len(sets[i]))
    own = (p.T @ p).astype(np.float64)
    value, vector = np.linalg.eigh(own)
    use = value > 1e-6 * value.max()
    whiten = vector[:, use] / np.sqrt(value[use])
    features = _kernel(sets, place, p) @ whiten
    y = np.array([[lang == name for name in names] for lang in langs], np.float64)
    count = y.sum(0)
    w = (y / count).sum(1)  # each language weighs the same
    left = features.T @ (features * w[:, None]) + ridge * np.eye(features.shape[1]) * w.mean()
    solved = np.linalg.solve(left, features.T @ (y * w[:, None]))
    weights = np.zeros((BUCKETS, len(names)), np.float32)
    weights[known] = p @ (whiten @ solved)
    return Model(names, weights)


def fit(docs: DataFrame) -> Model | None:
    """Learn from a bounded sample of docs (doc_id, text, lang)."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    order = W.partitionBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    picked = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= PER_SALT).select("doc_id").distinct()
    # SALTS * PER_SALT ids per language: a bounded broadcast. Ids may repeat, so the rows are bounded again
    sample = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null").join(F.broadcast(picked), "doc_id")
    own = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"))
    sample = sample.withColumn("rn", F.row_number().over(own)).filter(F.col("rn") <= SALTS * PER_SALT).select("lang", "rn", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(2).to_pylist()
            sets = [grams(t).astype("<i4").tobytes() if has_letter(t) else None for t in texts]
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(sets, pa.binary())], names=["lang", "rn", "grams"])

    got = sample.mapInArrow(made, "lang string, rn int, grams binary").filter("grams is not null").toArrow()
    rows = sorted(zip(got.column(1).to_pylist(), got.column(0).to_pylist(), got.column(2).to_pylist(), strict=True))
    return train([np.frombuffer(g, "<i4") for _, _, g in rows], [lang for _, lang, _ in rows])


def values(model: Model, texts: list[str]) -> np.ndarray:
    """Regression values, a row per text, a column per language."""
    sets = [grams(t) for t in texts]
    sizes = np.array([len(s) for s in sets])
    starts = np.append(0, np.cumsum(sizes)[:-1])
    return np.add.reduceat(model.weights[np.concatenate(sets)], starts, axis=0) / np.sqrt(sizes)[:, None]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (all columns, among them text) with lang_pred string and score double."""
    spark = docs.sparkSession
    _common.prepare(spark)
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = spark.sparkContext.broadcast(model)
    where = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for rows in batches:
            texts = rows.column(where).to_pylist()
            some = [i for i, t in enumerate(texts) if has_letter(t)]
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for i in range(0, len(some), 100):
                part = some[i : i + 100]
                v = values(shared.value, [texts[j] for j in part])
                best[part], score[part] = v.argmax(1), np.clip(v.max(1), 0, 1)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=[*rows.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(task, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang)."""
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
