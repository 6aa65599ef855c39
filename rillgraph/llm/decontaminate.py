"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is `size` consecutive words of an item; an item of fewer words is one window. Of each `size` words of a document the
smallest hash of its k-grams is kept, of both sides; equal spans have equal minima, so a span of `size` words or more always
shares one. Runs of windows with one minimum are one fingerprint (hash, first and last start). Fingerprints that both sides hold are
extended: the words of each candidate window are compared with the items' windows themselves, so no hash decides. Windows
of items below `size` words are found by their word of the smallest hash, wherever a document has that word.

Scale: each document is split into words once. Fingerprints and the document's own row leave it in one stream, of which the join keeps hits and
own rows only; it is a broadcast join only while Spark finds the fingerprints of the items below autoBroadcastJoinThreshold. Hits are kept by
text (SHA-256), so exact copies share them, and texts are read again only to verify candidates. Windows that occur in the
same items form one set of items, and a document is joined with sets, not with every window's items.

Cases: null text has no words; an item without words has no window. Repeated item rows with one id are one item. An item
without id is compared, its words are hit, but it is not counted or listed. A repeated document is a row of its own; null
ids are kept. Other columns are never read. Without items no document is contaminated; without documents there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillgraph.llm import _common

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then uses it, within functions of array elements too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _lower(text: Column) -> Column:
    """text with A-Z alone lower-cased. lower() does it fast wherever it leaves all other characters as they are."""
    other = F.regexp_replace(text, "[\\x00-\\x7F]+", "")
    return F.when(F.lower(other) == other, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """array<string>: the words of a text, null counting as empty."""
    return F.array_remove(F.split(_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _minima(h: Column, size: int, k: int) -> Column:
    """Of an array of at least `size` word hashes: for each window of `size` words the smallest hash of its k-grams."""
    grams = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
    width = size - k + 1
    return _let(grams, lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - width), lambda i: F.least(*(F.get(g, i + j) for j in range(width))) if width > 1 else F.get(g, i)))


def _runs(m: Column) -> Column:
    """Fingerprints (hash, start, stop) of an array of minima: starts from start to stop - 1 have this minimum."""
    heads = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
    return _let(heads, lambda r: F.transform(r, lambda i, j: F.struct(F.get(m, i).alias("hash"), i.alias("start"), F.coalesce(F.get(r, j + 1), F.size(m)).alias("stop"))))


class Items:
    """The benchmark's windows, fingerprints and sets of items, as written tables."""

    def __init__(self, benchmark: DataFrame, size: int, k: int):
        if not 1 <= k <= size:
            raise ValueError("k must be from 1 to size")
        rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter("size(w) > 0")
        rows = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
        long = F.transform(F.when(F.size("w") >= size, _minima(F.col("h"), size, k)), lambda m, i: F.struct(F.array_join(F.slice("w", i + 1, size), " ").alias("window"), F.lit(size).alias("len"), m.alias("hash"), F.lit(0).alias("skip")))
        least = F.array_min("h")
        short = F.array(F.struct(F.array_join("w", " ").alias("window"), F.size("w").alias("len"), least.alias("hash"), (F.array_position("h", least).cast("int") - 1).alias("skip")))
        each, _ = _common.written(rows.select("item", F.inline(F.when(F.size("w") >= size, long).otherwise(short))).distinct(), "item-windows")
        #: hash of every minimum of a long window
        self.prints, _ = _common.written(each.filter(F.col("len") == size).select("hash").distinct(), "item-prints")
        #: hash of the word that finds a short window, its place there, and the window's length
        self.anchors, _ = _common.written(each.filter(F.col("len") < size).select("hash", "len", "skip").distinct(), "item-anchors")
        of = each.groupBy("window", "len").agg(F.count("item").alias("n"), F.sum(F.xxhash64("item").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("x"))
        #: window, len and the set of items that hold it, named by the items' number and hashes
        self.windows, _ = _common.written(of.select("window", "len", F.struct("n", "s", "x").alias("set")), "windows")
        #: set, item
        self.sets, _ = _common.written(each.filter("item is not null").join(self.windows, ["window", "len"]).select("set", "item").distinct(), "item-sets")


def _stream(docs: DataFrame, items: Items, size: int, k: int) -> DataFrame:
    """id, same (the text's hash), start, stop, skip, len, n_words: each document's own row (len 0), and what it shares with items."""
    own = lambda n: F.struct(F.xxhash64("same").alias("hash"), F.lit(0).alias("start"), F.lit(0).alias("stop"), n.alias("n_words"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.unhex(F.sha2(text, 256)).alias("same"), F.transform(words(text), lambda x: F.xxhash64(x)).alias("h"))

    def found(h: Column) -> Column:
        runs = F.when(F.size(h) >= size, _let(_minima(h, size, k), _runs)).otherwise(F.array())
        return F.concat(F.array(own(F.size(h))), F.transform(runs, lambda r: F.struct(r["hash"].alias("hash"), r["start"].alias("start"), r["stop"].alias("stop"), F.lit(0).alias("n_words"))))

    def places(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.struct(x.alias("hash"), i.alias("start"), (i + 1).alias("stop")))

    shared = items.prints.withColumn("shared", F.lit(True))
    out = rows.select("id", "same", F.inline(_let(F.col("h"), found))).join(shared, "hash", "left").filter("shared or stop = 0")
    out = out.select("id", "same", "start", "stop", F.lit(0).alias("skip"), F.when(F.col("stop") > 0, size).otherwise(0).alias("len"), "n_words")
    if items.anchors.isEmpty():
        return out
    short = rows.select("id", "same", F.inline(_let(F.col("h"), places))).join(items.anchors, "hash")
    return out.unionByName(short.select("id", "same", "start", "stop", "skip", "len", F.lit(0).alias("n_words")))


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, sets): doc_id, same and n_words of each document; (same, start, len, set) of each occurrence of a window in a
    text, start counted in words from 0; (set, item) for the items of a set."""
    items = Items(benchmark, size, k)
    stream, _ = _common.written(_stream(docs, items, size, k), "prints")
    spots = stream.filter("len > 0").select("same", "len", F.explode(F.sequence(F.col("start") - F.col("skip"), F.col("stop") - 1 - F.col("skip"))).alias("start")).filter("start >= 0")
    spots, _ = _common.written(spots.groupBy("same").agg(F.collect_set(F.struct("start", "len")).alias("spots")), "spots")
    # eight bytes a candidate sift the texts first, without moving them while Spark may broadcast the keys
    keys, _ = _common.written(spots.select(F.xxhash64("same").alias("key")), "spot-keys")
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("same", F.unhex(F.sha2("text", 256)))
    texts = texts.join(keys, F.xxhash64("same") == F.col("key"), "left_semi").join(spots, "same")
    read = lambda w: F.transform("spots", lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), F.array_join(F.slice(w, s["start"] + 1, s["len"]), " ").alias("window")))
    hits = texts.select("same", F.inline(_let(words(F.col("text")), read))).join(items.windows, ["window", "len"]).select("same", "start", "len", "set").distinct()
    hits, _ = _common.written(hits, "window-hits")
    return stream.filter("len = 0").select(F.col("id").alias("doc_id"), "same", "n_words"), hits, items.sets


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any window), n_items long, items_sha256 (of the sorted, comma-joined item ids), contaminated."""
    rows, hits, sets = matches(docs, benchmark, size, k)
    before = F.max(F.col("start") + F.col("len")).over(W.partitionBy("same").orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1))
    ends = hits.select("same", "start", "len").distinct().withColumn("upto", F.coalesce(before, F.lit(0)))
    new = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", "upto"))
    words_hit = ends.groupBy("same").agg(F.sum(new).alias("n_hit"))
    named = hits.select("same", "set").distinct().join(sets, "set").select("same", "item").distinct()
    listed = named.groupBy("same").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("ids"))
    found, _ = _common.written(words_hit.join(listed, "same", "left"), "contaminated")
    out = rows.join(found, "same", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
