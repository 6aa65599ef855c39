"""Filter interaction audit: what each filter removes in each order of application, from one cube of the failure flags.

Documents are first summed by part and flags, so the cube expands at most 2^n rows a part, however many documents there are.
A grouping set of the cube is a subset of filters; its row in which all selected flags are false counts the documents that
pass the subset. A step of an order goes from one subset to the next larger one, so all figures of a step are differences
between two survivors, found by joining pairs of subsets.

Cases: null text is empty (it fails A; 0 words, so not B); null part is the empty string. A repeated row counts each time; one of two rows with
the same text and doc_id is not a copy of the other, as no doc_id is smaller. A null doc_id is neither smaller nor larger
than any, and has no label. Several labels of a document: one 1 is enough. Other columns are never read. No documents, no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.llm import _common

UPPER = "[^A-Z]+"
WORD = "[^\\x20\\x09-\\x0D]+"
MARKS = "[#$%&*|]"


def text_flags(text: Column) -> dict[str, Column]:
    """A: under 100 words; B: under 80 % distinct words; C: over 10 % capitals A-Z; D: any of `#$%&*|`."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, UPPER, "")).cast("long") > 10 * F.length(text).cast("long"),
        "D": F.regexp_like(text, F.lit(MARKS)),
    }


def flagged(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part string, A to E, good, toxic (booleans) of every document. E: some smaller doc_id has the same text.

    The text travels as its SHA-256. Only texts of several ids are joined back, so a group of copies, however large, is one
    row on that side, and adaptive execution can split the documents' side.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "doc_id", F.unhex(F.sha2(text, 256)).alias("same"), *(c.alias(k) for k, c in text_flags(text).items()))
    first, _ = _common.written(rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("same", "first"), "copies")
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marks, _ = _common.written(marks.filter("doc_id is not null and (good or toxic)"), "marks")
    rows = rows.join(first, "same", "left").join(marks, "doc_id", "left")
    no = F.lit(False)
    return rows.select("part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def survivors(rows: DataFrame, filters: str) -> DataFrame:
    """part, passed int (bit i: filter i must be passed), n, good, toxic long, for each subset of filters, zeros included."""
    counts = rows.groupBy("part", *filters).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    selected = sum(((1 - F.grouping(f)) * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    cube = counts.cube("part", *filters).agg(F.grouping("part").alias("all_parts"), selected.cast("int").alias("passed"), *(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    pure = cube.filter("all_parts = 0").filter(" and ".join(f"not coalesce({f}, false)" for f in filters)).select("part", "passed", "n", "good", "toxic")
    pure, _ = _common.written(pure, "survivors")
    every = pure.filter("passed = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("passed"))
    return every.join(pure, ["part", "passed"], "left").na.fill(0, ["n", "good", "toxic"])


def steps(rows: DataFrame, filters: str) -> DataFrame:
    """rows (part string, one boolean per filter, good, toxic) audited: one row per part, order and step.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, as op13 has them. filters: one letter each, at most
    8, as there is a row for each permutation.
    """
    if not 1 <= len(filters) <= 8:
        raise ValueError("1 to 8 filters")
    spark = rows.sparkSession
    alive, _ = _common.written(survivors(rows, filters), "subsets")
    all_, bit = (1 << len(filters)) - 1, {f: 1 << i for i, f in enumerate(filters)}

    def of(prefix: str) -> DataFrame:
        return alive.select("part", *(F.col(c).alias(f"{prefix}_{c}") for c in ("passed", "n", "good", "toxic")))

    pairs = spark.createDataFrame([(f, s, s | b) for f, b in bit.items() for s in range(all_ + 1) if not s & b], "filter string, pair_before int, pair_after int")
    gone = of("before").join(F.broadcast(pairs), F.col("before_passed") == F.col("pair_before"))
    after = of("after").withColumnRenamed("part", "after_part")
    gone = gone.join(after, (F.col("part") == F.col("after_part")) & (F.col("pair_after") == F.col("after_passed")))
    gone = gone.select(
        "part", "filter", F.col("pair_before").alias("before"), F.col("after_n").alias("kept"), *((F.col(f"before_{c}") - F.col(f"after_{c}")).alias(name) for c, name in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost")))
    )
    gone, _ = _common.written(gone, "pairs")
    # a filter alone, and a filter after all others, are pairs of subsets too
    last = F.create_map(*(x for f, b in bit.items() for x in (F.lit(f), F.lit(all_ ^ b))))
    fails = gone.groupBy("part", "filter").agg(F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"), F.max(F.when(F.col("before") == last[F.col("filter")], F.col("removed"))).alias("unique_fails"))
    orders = [("".join(p), i + 1, p[i], sum(bit[f] for f in p[:i])) for p in permutations(filters) for i in range(len(p))]
    orders = spark.createDataFrame(orders, "filter_order string, step int, filter string, before int")
    each = gone.join(F.broadcast(orders), ["filter", "before"])
    share = each.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    out = each.join(fails, ["part", "filter"]).join(share, ["part", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
