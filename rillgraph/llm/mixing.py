"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has the exponential key -ln(u) / w, u a uniform number derived from its id and the seed, w its
quality weight. A source's target words are its share of the mix; whole epochs of the source come first, and the
fractional rest takes documents in key order while the prefix sum of their words stays nearest the budget.

No source is ever sorted in one task: rows fall into ordered ranges of their keys, whose word sums are aggregated before
the shuffle, and only the range that holds a source's budget is looked at again. While that range holds more than
WINDOW rows it is cut into ranges by the key's next digits, then by size, then by the row's number; the rest is sorted
exactly. So a source of junk, whose keys lie close together, and rows with one key are cut like others.

Cases: null text has size 0 and is taken 0 words; null sources form a source of their own, last in order; ties of
keys (repeated or null ids) are ordered by id, size and a hash of the row's number in its table, so that of equal
rows as many are taken as the budget holds; extra columns are never read. A source without words has target 0. An
empty table gives an empty result. Reruns over the same files agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillgraph.llm import _common

#: Ordered ranges per source and step.
BUCKETS = 1024
#: Rows of a source that one task sorts, at most.
WINDOW = 50_000
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    """Number of maximal runs without white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_weight(text: Column) -> Column:
    """A document's quality weight, .1 to 1.1: the share of letters, spaces and line ends among its characters."""
    clean = F.length(F.regexp_replace(text, "[^\\p{L} \\n]", ""))
    return F.lit(0.1) + F.coalesce(clean.cast("double") / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def es_key(doc_id: Column, weight: Column, seed: str = "") -> Column:
    """-ln(u) / weight with u from the first 52 bits of md5(doc_id and seed); ascending keys are sampled first."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / weight


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, source_size): water-filling of total * all words by weight.

    Sources by code point, null last, take the weights in turn. With the sources by most * size / weight, those
    up to some place stop at their limit and the others share what is left. One row per source: a small dimension
    in one task.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weigh = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1)
    s = sizes.withColumn("w", weigh).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    s = s.withColumn("mix", F.sum("source_size").over(everything) * F.lit(float(total)))
    s = s.withColumn("level", (F.col("mix") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the level at the first source that it does not lift above its limit
    s = s.withColumn("final", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.row_number().over(fill).alias("at"), F.col("level")))).over(everything))
    open_ = F.row_number().over(fill) >= F.col("final.at")
    return s.select("source", "source_size", F.when(open_, F.col("final.level") * F.col("w")).otherwise(F.col("cap")).alias("target"))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    """docs with size, key and a number of the row's own; the caller writes them, so that the number is fixed."""
    key = es_key(F.col("doc_id"), text_weight(F.col("text")), seed)
    return docs.withColumns({"__size": n_words(F.col("text")), "__key": key, "__tie": F.xxhash64(F.monotonically_increasing_id())})


def _order() -> Column:
    return F.struct("__key", "doc_id", "__size", "__tie")


def _digits(buckets: int) -> list[Column]:
    """Ordered digits of a row's place: of its key, of its size, of its number. Together they follow the order of rows."""
    place = F.col("__key") / (F.col("__key") + 1)
    out = [F.pmod(F.floor(place * float(buckets) ** i), F.lit(buckets)).cast("int") for i in (1, 2, 3, 4)]
    out += [F.shiftright("__size", 20).cast("int"), F.shiftright("__size", 10).bitwiseAND(1023).cast("int"), F.col("__size").bitwiseAND(1023).cast("int")]
    # the arithmetic shift keeps the sign, and with it the order
    out += [F.shiftright("__tie", 54).cast("int"), *(F.shiftright("__tie", i).bitwiseAND(1023).cast("int") for i in (44, 34, 24, 14, 4))]
    return out


def _assigned(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized with the plan's columns of its source and __times, how often the mix takes a row: no row moves while plan is small."""
    p = plan.select(*(F.col(c).alias(f"__{c}") for c in ("source", "source_size", "target", "epochs", "last")))
    rows = sized.join(p, sized["source"].eqNullSafe(p["__source"]))
    more = F.coalesce(_order() <= F.col("__last"), F.lit(False))
    return rows.withColumn("__times", (F.col("__epochs") + more.cast("long")).cast("int"))


def plan(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, most: float = 2.0, buckets: int = BUCKETS, window: int = WINDOW) -> DataFrame:
    """One row per source: source_size, target, epochs, last.

    All words are taken `epochs` times; of the rest, the documents up to `last` (key, doc_id, size, tie); null: none.
    """
    digits = _digits(buckets)
    sized = sized.select("source", "doc_id", "__size", "__key", "__tie")
    sums = sized.groupBy("source", digits[0].alias("__digit")).agg(F.sum("__size").alias("words"), F.count("*").alias("n"), F.max(_order()).alias("top"))
    sums, _ = _common.written(sums, "mix-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total, most)
    goal = goal.withColumn("epochs", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal, _ = _common.written(goal, "mix-goal")

    none = F.lit(None).cast(sums.schema["top"].dataType)
    cuts = goal.filter("rest > 0").select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("start"), none.alias("floor"))
    inside = sized
    for i in range(len(digits)):
        if i:
            sums = _within(inside, cuts).groupBy("source", digits[i].alias("__digit")).agg(F.sum("__size").alias("words"), F.count("*").alias("n"), F.max(_order()).alias("top"))
        upto = W.partitionBy("source").orderBy("__digit")
        before = upto.rowsBetween(W.unboundedPreceding, -1)
        ranges = sums.join(cuts, sums["source"].eqNullSafe(cuts["s"])).withColumns({
            "at": F.col("start") + F.coalesce(F.sum("words").over(before), F.lit(0)),
            "under": F.coalesce(F.max("top").over(before), F.col("floor")),
        })
        # one range of a source starts within the budget and ends beyond it
        ranges = ranges.filter((F.col("at") <= F.col("rest")) & (F.col("at") + F.col("words") > F.col("rest")))
        cuts, _ = _common.written(ranges.select("s", "rest", F.col("at").alias("start"), F.col("under").alias("floor"), F.col("__digit").alias("d"), "n"), "mix-cut")
        inside = _within(inside, cuts, digits[i])
        cuts, largest = cuts.drop("d", "n"), cuts.agg(F.max("n")).first()[0]
        if (largest or 0) <= window:
            break
    prefix = W.partitionBy("source").orderBy("__key", "doc_id", "__size", "__tie").rowsBetween(W.unboundedPreceding, -1)
    taken = _within(inside, cuts).withColumn("before", F.col("start") + F.coalesce(F.sum("__size").over(prefix), F.lit(0)))
    last = taken.filter(F.col("before") + F.col("__size") / 2 <= F.col("rest")).groupBy(F.col("source").alias("l")).agg(F.max(_order()).alias("last"))
    ends = cuts.join(last, F.col("s").eqNullSafe(F.col("l")), "left").select(F.col("s").alias("e"), F.coalesce("last", "floor").alias("last"))
    out = goal.join(ends, goal["source"].eqNullSafe(F.col("e")), "left").select("source", "source_size", "target", "epochs", "last")
    return _common.written(out, "mix-plan")[0]


def _within(rows: DataFrame, cuts: DataFrame, digit: Column | None = None) -> DataFrame:
    """The rows of the cuts' sources; with a digit, those in the cut range only, without the cuts' columns."""
    if digit is None:
        return rows.join(cuts, rows["source"].eqNullSafe(cuts["s"]))
    return rows.join(cuts.select("s", "d"), rows["source"].eqNullSafe(cuts["s"]) & (digit == F.col("d"))).drop("s", "d")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, most: float = 2.0, seed: str = "", buckets: int = BUCKETS, window: int = WINDOW) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, text, source)."""
    sized, _ = _common.written(_sized(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix-sized")
    out = _assigned(sized, plan(sized, weights, total, most, buckets, window))
    return out.select("doc_id", "source", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__times")).cast("long").alias("taken"))


def repeat(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, most: float = 2.0, seed: str = "", buckets: int = BUCKETS, window: int = WINDOW) -> DataFrame:
    """docs (all columns, among them doc_id, text, source), each row as often as the mix takes it.

    The rows are written once with their sizes and keys: the texts are searched once, and no row moves.
    """
    docs, back = _common.aside(docs, ("doc_id", "text", "source"))
    rows, _ = _common.written(_sized(docs, seed), "mix-rows")
    out = _assigned(rows, plan(rows, weights, total, most, buckets, window)).filter("__times > 0")
    return back(out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))))
