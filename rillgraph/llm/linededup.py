"""Line dedup over levelled sorted runs of line hashes.

A run is a table (key binary(16), docs long, again boolean), sorted by key within hash partitions: for every line key of
one batch, in how many documents of that batch it occurs, and whether an older run holds the key. A new batch
merge-anti-joins the runs: its unseen keys start, the keys that it has in common with them are counted on, and both
become its own run. So each key starts in one run only, and a key that never comes again is never aggregated again.
New runs enter level 0; whenever a level holds `fan_in` runs they are merged into one run of the next level, so n
batches leave O(log n) runs.

Key of a line: the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased; hashed with 128-bit XXH3, so
that even 10^12 lines collide with a probability below 10^-14.

Cases: null or empty text is one empty line, which has no key and always stays. A repeated row counts as a
document of its own; null ids are rows like others. Extra columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm import _common

#: Characters stripped at both ends of a line.
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of frequent keys up to which they are broadcast; beyond, lines are joined with them.
BROADCAST_BYTES = 16 << 20


def _keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The hashed key of each line; None if the key is shorter than min_chars."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(SPACE).lower()
        long_enough = len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if key and long_enough else None)
    return out


def line_keys(docs: DataFrame, batches: int = 1, min_chars: int = 1) -> DataFrame:
    """(batch int, key binary): each distinct key of each document once. docs: batch int, text string."""

    def explode(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches_:
            at, keys = [], []
            for b, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                own = set(_keys(text.as_py(), min_chars)) - {None}
                at += [b] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.binary())], names=["batch", "key"])

    return docs.select("batch", "text").mapInArrow(explode, "batch int, key binary")


_RUN = "key binary, docs long, again boolean"


class LineRuns:
    """Levelled sorted runs in the shared folder. State on the driver: paths and levels of O(log batches) runs."""

    def __init__(self, spark: SparkSession, fan_in: int = 4, min_chars: int = 1):
        self.spark, self.fan_in, self.min_chars = spark, fan_in, min_chars
        self.levels: list[list[str]] = [[]]

    def _union(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(*paths)

    def _put(self, level: int, rows: DataFrame) -> None:
        _, path = _common.written(rows.sortWithinPartitions("key"), f"lines-l{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def compact(self) -> None:
        """Merge each level that holds fan_in runs or more into one run of the next level."""
        level = 0
        while level < len(self.levels):
            full = self.levels[level]
            if len(full) >= self.fan_in:
                merged = self._union(full).groupBy("key").agg(F.sum("docs").alias("docs"), F.min("again").alias("again"))
                self._put(level + 1, merged)
                self.levels[level] = []
                for old in full:
                    _common.remove(self.spark, old)
            level += 1

    def unseen(self, keys: DataFrame, how: str = "left_anti") -> DataFrame:
        """The rows of keys whose key no run holds yet: a sort-merge anti-join; left_semi: the others."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return keys if how == "left_anti" else keys.limit(0)
        return keys.join(self._union(paths).filter("not again").select("key").hint("merge"), "key", how)

    def add_counts(self, counts: DataFrame) -> None:
        """Add the run of a batch: (key, docs), each key once."""
        new = self.unseen(counts).withColumn("again", F.lit(False))
        if any(self.levels):
            new = new.unionAll(self.unseen(counts, "left_semi").withColumn("again", F.lit(True)))
        self._put(0, new)
        self.compact()

    def add(self, docs: DataFrame) -> None:
        """Add the run of one batch of documents (text string)."""
        keys = line_keys(docs.select(F.lit(0).alias("batch"), "text"), min_chars=self.min_chars)
        self.add_counts(keys.groupBy("key").agg(F.count("*").alias("docs")))

    def add_many(self, docs: DataFrame, batches: int) -> None:
        """Add several batches one after another; one scan counts their keys. docs: batch int from 0, text string."""
        counts = line_keys(docs, min_chars=self.min_chars).groupBy("batch", "key").agg(F.count("*").alias("docs"))
        counts, path = _common.written(counts.select("key", "docs", "batch"), "lines-new", ("batch",))
        for b in range(batches):
            self.add_counts(counts.filter(F.col("batch") == b).select("key", "docs"))
        _common.remove(self.spark, path)

    def all(self) -> DataFrame:
        """(key, docs, again) over all runs; a key has one row that is not `again`, and one more per later run that holds it."""
        paths = [p for level in self.levels for p in level]
        return self._union(paths) if paths else self.spark.createDataFrame([], _RUN)

    def frequent(self, min_docs: int) -> DataFrame:
        """The keys that at least min_docs documents hold. Only keys that came again are summed."""
        rows = self.all()
        more = rows.filter("again").groupBy("key").agg(F.sum("docs").alias("more"))
        first = rows.filter("not again").select("key", "docs")
        grown = first.filter(F.col("docs") < min_docs).join(more, "key").filter(F.col("docs") + F.col("more") >= min_docs)
        return first.filter(F.col("docs") >= min_docs).select("key").unionAll(grown.select("key"))


def _kept(text: str | None, drop: list[bool]) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    return len(lines), sum(drop), "\n".join(x for x, gone in zip(lines, drop, strict=True) if not gone)


_OUT = "n_lines long, n_dropped long, kept string"


def _with_kept(rows: pa.RecordBatch, columns: list, names: list[str], drops: Iterator[tuple[str | None, list[bool]]]) -> pa.RecordBatch:
    made = [_kept(text, drop) for text, drop in drops]
    lists = zip(*made, strict=True) if made else ((), (), ())
    extra = [pa.array(list(x), t) for x, t in zip(lists, (pa.int64(), pa.int64(), pa.string()), strict=True)]
    return pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, "n_lines", "n_dropped", "kept"])


def drop_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs (all columns, among them text) with n_lines, n_dropped and kept; lines whose key is in frequent go.

    The keys' number is counted first. While they take at most broadcast_bytes (16 bytes a key) they are broadcast as
    one sorted array and the pass moves no text; beyond, (row, position, key) is joined with them and the positions
    to drop come back to the texts by row content, which holds for any number of keys. Columns of docs that have the
    name of a result give way to it.
    """
    spark = docs.sparkSession
    docs, back = _common.aside(docs.drop("n_lines", "n_dropped", "kept"), ("text",))
    n = frequent.count()
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + _OUT
    where = docs.columns.index("text")
    if n * 16 <= broadcast_bytes:
        known = spark.sparkContext.broadcast(np.sort(np.array(frequent.select("key").toArrow().column(0).to_pylist(), "S16")))

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = known.value
            for rows in batches:
                texts = rows.column(where).to_pylist()
                of = [_keys(t, min_chars) for t in texts]
                flat = np.array([k or b"" for own in of for k in own], "S16")
                at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
                hit = ((keys[at] == flat) if len(keys) else np.zeros(len(flat), bool)) & (flat != b"")
                ends = np.cumsum([len(own) for own in of])
                drops = zip(texts, (x.tolist() for x in np.split(hit, ends[:-1])), strict=True) if texts else iter(())
                yield _with_kept(rows, rows.columns, rows.schema.names, drops)
            pa.default_memory_pool().release_unused()

        return back(docs.mapInArrow(rewrite, out_schema), "n_lines", "n_dropped", "kept")

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            row, pos, key = [], [], []
            for text in rows.column(0).to_pylist():
                mine = xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
                for i, k in enumerate(_keys(text, min_chars)):
                    if k is not None:
                        row.append(mine)
                        pos.append(i)
                        key.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.binary()), pa.array(pos, pa.int32()), pa.array(key, pa.binary())], names=["__row", "pos", "key"])

    # equal texts lose the same positions, so the content's hash identifies the row
    hits = docs.select("text").mapInArrow(positions, "__row binary, pos int, key binary").join(frequent, "key").select("__row", "pos").distinct()
    gone = hits.groupBy("__row").agg(F.collect_list("pos").alias("__gone"))

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = [xxhash.xxh3_128_digest((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in rows.column(where)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.binary())], names=[*rows.schema.names, "__row"])

    base = docs.mapInArrow(content, out_schema.removesuffix(_OUT) + "__row binary").join(gone, "__row", "left").drop("__row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            drops = []
            for text, at in zip(rows.column(where).to_pylist(), rows.column(rows.num_columns - 1).to_pylist(), strict=True):
                drop = np.zeros((text or "").count("\n") + 1, bool)
                drop[at or []] = True
                drops.append((text, drop.tolist()))
            yield _with_kept(rows, rows.columns[:-1], rows.schema.names[:-1], iter(drops))

    return back(base.mapInArrow(cut, out_schema), "n_lines", "n_dropped", "kept")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fan_in: int = 4, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_lines, n_dropped and kept (the remaining text): lines found in min_docs documents or more go everywhere."""
    spark = docs.sparkSession
    _common.prepare(spark)
    runs = LineRuns(spark, fan_in, min_chars)
    runs.add_many(docs.select(F.pmod(F.xxhash64("text"), F.lit(batches)).cast("int").alias("batch"), "text"), batches)
    frequent, _ = _common.written(runs.frequent(min_docs), "lines-frequent")
    return drop_lines(docs, frequent, min_chars, broadcast_bytes)
