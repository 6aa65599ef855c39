"""A corpus pipeline of five stages: quality, line dedup, near-dedup, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents. Every stage
works on all rows that its predecessor kept, and its decisions take effect:

quality     rows whose predicted label is 0 go; others stay as they are
line dedup  lines found in 10 documents or more go from every document; n_chars follows; documents stay, if emptied too
near dedup  of each component at similarity 0.8 over five-word shingles, the row with the smallest id stays; null ids come
            last, ties go by a hash of the whole row
mixing      each document comes as often as the mix takes it (0, 1 or 2 times)
packing     pieces of sequences of at most 2048 ids

Null texts have no quality (score 0) and go in the first stage; rows with a null id are kept like others. Columns of any
name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm import _common, linededup, mixing, neardup, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier accepts."""
    model = quality.fit(docs, _common.table(spark, sf_dir, "labels"))
    rows, back = _common.aside(docs, ("doc_id", "text"))
    return back(quality.score(rows, model).filter("predicted = 1"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that many documents share."""
    rows, back = _common.aside(docs, ("text", "n_chars"))
    out = linededup.dedup_lines(rows, min_docs=10)
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return back(out)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies. Rows are told apart by a number of their own: ids may repeat or be null."""
    plain, back = _common.aside(docs, ("doc_id", "text"))
    others = [c for c in plain.columns if c not in ("doc_id", "text")]  # maps have no hash, but a text
    tie = F.xxhash64("doc_id", "text", F.isnull("text"), F.to_json(F.struct(*others)) if others else F.lit(""))
    rows, _ = _common.written(plain.select(F.struct(*plain.columns).alias("row"), tie.alias("tie"), F.monotonically_increasing_id().alias("key")), "near-rows")
    found = neardup.near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), n=5)
    found, _ = _common.written(found.select(F.col("doc_id").alias("key"), "component_id"), "near")
    groups = found.groupBy("component_id").count().filter("count > 1").select("component_id")
    order = F.struct(F.isnull("row.doc_id").alias("unnamed"), F.col("row.doc_id").alias("id"), "tie", "key")
    members, _ = _common.written(found.join(groups, "component_id").join(rows.select("key", order.alias("order")), "key"), "near-members")
    first = members.groupBy("component_id").agg(F.min("order").alias("first"))
    gone, _ = _common.written(members.join(first, "component_id").filter("key <> first.key").select("key"), "near-gone")
    return back(rows.join(gone, "key", "left_anti").select("row.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it."""
    return mixing.repeat(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows."""
    return packing.pack(docs, packing.public_words())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Classifier, tokenizer ids and packing cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = _common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = _common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
