"""Source divergence audit: how far the sources of a language differ in their terms, by two-dimensional tiling.

Terms are counted per (lang, source, term) in one pass. A language keeps the terms of at least `min_docs` of its documents,
V in all; they are dealt to vocabulary chunks by hash. A group's counts of a chunk are packed into two arrays. Sources
are dealt to blocks by hash, and each packed vector is replicated to every tile (block x block) that its block takes part in.
A tile's unit of work is a span of successive chunks: it sees at most two blocks' groups and one span's terms, walks the
chunks one after another, and adds each to its pair submatrix; the submatrices of a tile's spans are then summed. So the
work of a language with a third of all rows is spread over all its spans and tiles.

p = 1 + floor(10^9 (count + 2) / (N + 2 V)) of a group and term, N the group's occurrences of kept terms; f = floor((p - q)^2 / (p + q)).
All is integer arithmetic: p by JVM decimals for the term part, by long division in three digits of a thousand for the pairs,
exact while a language has below 9 * 10^15 occurrences; f fits 64 bits as p is at most 10^9 + 1.

Cases: null text, lang and source are empty strings. Repeated rows are documents of their own. A group without terms takes
part with p of counts 0; a language without kept terms gives its pairs the value 0. Ties go by the item's UTF-8 bytes.
Other columns are never read. No documents, no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillgraph.llm import _common

SCALE, THOUSAND = 1_000_000_000, 1000
#: Terms of a chunk, chunks of a span, sources of a block (by hash, so about).
CHUNK, SPAN, BLOCK = 2048, 8, 32
#: Distinct terms that a task counts before it passes them on.
HELD = 200_000
#: Byte of a text -> lower-cased letter or byte above ASCII, or a blank.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

_COUNTS = "lang string, source string, term binary, docs long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each (lang, source) of the task, summed until HELD are held; every group has a row for the empty term."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, docs) in held.items():
            terms = list(total)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                same = [pa.array([x] * len(part), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(part, pa.binary()), pa.array([docs[t] for t in part], pa.int64()), pa.array([total[t] for t in part], pa.int64())], names=["lang", "source", "term", "docs", "n"])
        held.clear()

    size = 0
    for rows in batches:
        for lang, source, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
            own = Counter((text.cast(pa.binary()).as_py() or b"").translate(FOLD).split())
            total, docs = held.setdefault((lang, source), (Counter({b"": 0}), Counter()))
            before = len(total)
            total.update(own)
            docs.update(own.keys())
            size += len(total) - before
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term string, docs, n: in how many documents of the group a term is, and how often; term '' is there for every group."""
    empty = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")))
    counted = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    return counted.withColumn("term", F.col("term").cast("string"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count, exactly."""
    ten = F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", ten * (n + 2).cast("decimal(19,0)"), (total + 2 * terms).cast("decimal(19,0)"))


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / total) by long division, three digits at a time; counts + 2 is at most total."""
    whole, rest = np.divmod(counts + 2, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * THOUSAND, total)
        whole = whole * THOUSAND + digit
    return 1 + whole


def _tile(table: pa.Table) -> pa.Table:
    """lang, one, two, value: the pair submatrix of one unit, value summed over the unit's chunks.

    table: lang, side (0 of the tile's smaller block, 1 of the larger; 0 if they are one), diagonal, source, total, chunk, widths, places and counts
    (null chunk: the group's own row, which every group of the tile has, with the widths of the unit's chunks).
    """
    rows = table.to_pylist()
    heads = sorted((r["side"], r["source"], r["total"]) for r in rows if r["chunk"] is None)
    at = {(side, source): i for i, (side, source, _) in enumerate(heads)}
    total = np.array([h[2] for h in heads], np.int64)[:, None]
    left = np.array([h[0] == 0 for h in heads])
    diagonal = rows[0]["diagonal"]
    sums = np.zeros((len(heads), len(heads)), np.int64)
    chunks: dict[int, list[dict]] = {}
    for r in rows:
        if r["chunk"] is not None:
            chunks.setdefault(r["chunk"], []).append(r)
    for chunk, width in ((x["chunk"], x["width"]) for x in next(r["widths"] for r in rows if r["chunk"] is None) or ()):
        counts = np.zeros((len(heads), width), np.int64)
        for r in chunks.get(chunk, ()):
            counts[at[r["side"], r["source"]], np.array(r["places"], np.int64)] = r["counts"]
        p = _shares(counts, np.maximum(total, 1))
        for i in np.flatnonzero(left):
            others = np.arange(i + 1, len(heads)) if diagonal else np.flatnonzero(~left)
            d = p[others] - p[i]
            sums[i, others] += (d * d // (p[others] + p[i])).sum(1)
    one, two, value = [], [], []
    for i in np.flatnonzero(left):
        for j in np.arange(i + 1, len(heads)) if diagonal else np.flatnonzero(~left):
            one.append(heads[i][1])
            two.append(heads[j][1])
            value.append(int(sums[i, j]))
    return pa.table([pa.array([rows[0]["lang"]] * len(one), pa.string()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(value, pa.int64())], names=["lang", "one", "two", "value"])


class Vocabulary:
    """Counts, kept terms and totals of languages and groups, as written tables."""

    def __init__(self, docs: DataFrame, min_docs: int):
        counts, path = _common.written(term_counts(docs), "term-counts")
        kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs)
        kept, _ = _common.written(kept.select("lang", "term", "lang_n"), "kept-terms")
        #: lang, terms (V), lang_total (N)
        self.langs, _ = _common.written(counts.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "lang", "left").na.fill(0), "langs")
        #: lang, term, lang_n
        self.kept = kept
        #: lang, source, term, n, lang_n of kept terms
        self.cells, _ = _common.written(counts.filter("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "cells")
        totals = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        #: lang, source, total (N), terms (V), lang_total
        groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0).join(self.langs, "lang")
        self.groups, _ = _common.written(groups, "groups")
        _common.remove(docs.sparkSession, path)


def pair_values(vocabulary: Vocabulary, chunk: int = CHUNK, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """lang, source, item (another source of the lang), value: f summed over all kept terms, for all pairs, both ways."""
    v = vocabulary
    sizes = v.groups.groupBy("lang").agg(F.count("*").alias("sources"))
    blocks = F.ceil(F.col("sources") / block).cast("int")
    groups = v.groups.join(sizes, "lang").select("lang", "source", (F.col("total") + 2 * F.col("terms")).alias("total"), blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block"))
    groups, _ = _common.written(groups, "blocks")
    # a term's chunk by hash, its place in the chunk by order: both windows hold about `chunk` rows
    chunks = F.greatest(F.lit(1), F.ceil(F.col("terms") / chunk).cast("int"))
    named = v.kept.join(v.langs, "lang").select("lang", "term", F.pmod(F.xxhash64("term"), chunks).cast("int").alias("chunk"))
    placed, _ = _common.written(named.withColumn("place", F.row_number().over(W.partitionBy("lang", "chunk").orderBy("term")) - 1), "places")
    widths = placed.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width")).withColumn("span", F.floor(F.col("chunk") / span).cast("int"))
    spans = widths.groupBy("lang", "span").agg(F.array_sort(F.collect_list(F.struct("chunk", "width"))).alias("widths"))
    spans = v.langs.select("lang").join(spans, "lang", "left").na.fill(0, ["span"])  # a language without kept terms has one span of no chunks
    packed = v.cells.join(placed, ["lang", "term"]).groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("cells"))
    packed = packed.select("lang", "source", "chunk", F.floor(F.col("chunk") / span).cast("int").alias("span"), F.col("cells.place").alias("places"), F.col("cells.n").alias("counts"))
    # one row per group and span, also where the group has none of the span's terms, then one per packed vector
    head = groups.join(spans, "lang").select("lang", "source", "total", "block", "blocks", "span", "widths", F.lit(None).cast("int").alias("chunk"), F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<long>").alias("counts"))
    body = packed.join(groups, ["lang", "source"]).select("lang", "source", "total", "block", "blocks", "span", F.lit(None).cast(head.schema["widths"].dataType).alias("widths"), "chunk", "places", "counts")
    tiles = head.unionAll(body).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(
        "lang", "span", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("diagonal"),
        "source", "total", "chunk", "widths", "places", "counts",
    )

    def unit(table: pa.Table) -> pa.Table:
        return _tile(table.select(["lang", "side", "diagonal", "source", "total", "chunk", "widths", "places", "counts"]))

    parts = tiles.groupBy("lang", "span", "low", "high").applyInArrow(unit, "lang string, one string, two string, value long")
    found = parts.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    both = found.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("x"), "value")
    return both.select("lang", "x.source", "x.item", "value")


def term_values(vocabulary: Vocabulary) -> DataFrame:
    """lang, source, item (a kept term that the group has, more often than its lang as a whole), value."""
    v = vocabulary
    rows = v.cells.filter("n > 0").join(v.groups, ["lang", "source"])
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    return rows.select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, chunk: int = CHUNK, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of the lang (part pair), and the `top` terms (part term), by value descending."""
    _common.prepare(docs.sparkSession)
    vocabulary = Vocabulary(docs, min_docs)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(vocabulary, chunk, span, block).withColumn("rank", F.row_number().over(order))
    terms = term_values(vocabulary).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    parts = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return parts.select("lang", "source", "part", "item", "value", "rank")
