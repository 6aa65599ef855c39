"""MinHash near-dedup by a signature-coordinate inverted join.

1. One pass makes each document's set of word shingles, its digest and its signature of COORDINATES minima.
   Equal sets become one node, so exact copies never meet in a join.
2. Nodes are posted under each (coordinate, value). Values held once cannot collide and go. Two nodes that agree in
   at least MATCHES coordinates share one of each other's COORDINATES - MATCHES + 1 rarest postings (prefix), so
   only those are kept; the other, longer postings are skipped, and collisions there are counted by comparing the
   signatures of the nodes that met, which costs less than to merge the long postings.
3. Only links between different components matter for the result, so pairs of a group are never listed. First each
   node is tried with that smallest node of its postings with which it collides most; the links give components.
4. Postings that still hold several components are compared again, in blocks of BLOCK signatures: the nodes outside of
   a posting's largest component with those inside it and with each other, never the largest component with itself.
   A posting of L nodes with M outside is L * M / BLOCK rows of a signature; M is small where one group is large. What
   comes out is linear: the nodes that may link into another component, and stars that join the components in question
   into families.
5. A family's nodes in question are compared in the same blocks, this time with their texts: pairs of different
   components with MATCHES collisions are confirmed on the full sets, best first, while their components are still
   apart. Again only stars come out.

A candidate is a link only if the full sets confirm it: 100 * intersection >= 80 * union.

A pair at the threshold itself has a signature agreement of Bin(32, .8): it misses MATCHES = 15 with probability
5e-6, and pairs above it less often.

Cases: null or empty texts, and texts of white space only, have no shingle and link with nothing. Texts with fewer
words than a shingle are one shingle. Repeated rows are one node. Ids that repeat with different texts are separate
nodes; a component is named by its smallest id. Rows with a null id link like others; a component without any id has a
null component_id, and its rows are all kept. Extra columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.llm import _common
from rillgraph.llm.components import components

COORDINATES = 32
MATCHES = 15
#: Signatures on each side of one comparison.
BLOCK = 512
#: Rows that one unit of a comparison holds, about.
UNIT = 4000
#: Nodes that one unit tries with a pivot.
CHUNK = 256
#: Word hashes that a worker remembers within a task.
CACHE_WORDS = 200_000

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)  # fixed values: the multipliers of the splitmix64 generator
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _MULTIPLY)
_XOR, _TIMES = _SEEDS[:COORDINATES], _SEEDS[COORDINATES:] | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = _WordHashes()


def _forget() -> None:
    """Give back what a finished task remembers: its worker lives on for other stages."""
    _WORDS.clear()
    pa.default_memory_pool().release_unused()


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of the text's n-word shingles; words end at ASCII white space, A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * _MULTIPLY + h[i : len(h) - k + 1 + i]
    return np.unique(_mixed(out + np.uint64(k)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """COORDINATES minima, 32 bits each."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        best = np.minimum(best, ((hashes[i : i + 2048, None] ^ _XOR) * _TIMES).min(0))
    return (best >> np.uint64(32)).astype("<u4")


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, rid, n_shingles, fp (digest of the set; null: empty), sig."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            size, fp, sig = [], [], []
            for text in rows.column(2):
                s = shingles(text.as_py(), n)
                size.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(size, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "rid", "n_shingles", "fp", "sig"])
        _forget()

    return docs.select(F.col("doc_id").cast("long"), _rid(), "text").mapInArrow(task, "doc_id long, rid long, n_shingles long, fp binary, sig binary")


def _rid() -> Column:
    """What texts are found again by: the id, or a hash of the text where it is null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("rid")


def _postings(nodes: DataFrame) -> DataFrame:
    """(key long, node long): a node under each coordinate and value."""
    at = np.arange(COORDINATES, dtype=np.int64) << np.int64(32)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                sig = np.frombuffer(b"".join(rows.column(1).to_pylist()), "<u4").reshape(-1, COORDINATES)
                node = np.repeat(rows.column(0).to_numpy(zero_copy_only=False), COORDINATES)
                yield pa.RecordBatch.from_arrays([pa.array((sig + at).ravel()), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(task, "key long, node long")


def _lists(nodes: DataFrame) -> DataFrame:
    """(node, all): a node's postings that others share too, rarest first; nodes with fewer than MATCHES cannot link."""
    posted = _postings(nodes)
    shared = posted.groupBy("key").agg(F.count("*").alias("held"), F.min("node").alias("pivot")).filter("held > 1")
    mine = posted.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "key", "pivot"))).alias("all"))
    return mine.filter(F.size("all") >= MATCHES)


def _prefix(lists: DataFrame) -> DataFrame:
    """(node, key, pivot): the postings that matching nodes must share; pivot is the smallest node that has the key."""
    return lists.select("node", F.explode(F.slice("all", F.lit(1), F.size("all") - (MATCHES - 1))).alias("p")).select("node", "p.key", "p.pivot")


def _possible(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of collisions of rows a with rows b, and where they and the set sizes allow a link."""
    hits = np.zeros((len(a), len(b)), np.int16)
    for i in range(0, len(a), 64):
        hits[i : i + 64] = (a[i : i + 64, None, :] == b[None, :, :]).sum(2, dtype=np.int16)
    small, large = np.minimum(size_a[:, None], size_b[None, :]), np.maximum(size_a[:, None], size_b[None, :])
    return hits, (hits >= MATCHES) & (100 * small >= percent * large)


class _Union:
    """Components of numbers 0 to n - 1; the smallest names each."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def _groups(table: pa.Table, columns: list[str]) -> tuple[pa.Table, list[tuple[int, int]]]:
    """The table sorted by the columns, and the bounds of the runs of equal values."""
    table = table.sort_by([(c, "ascending") for c in columns])
    new = np.ones(len(table), bool)
    new[1:] = False
    for c in columns:
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    starts = np.append(np.flatnonzero(new), len(table))
    return table, list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))


def _sigs(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def _units(rows: DataFrame, by: list[str], number: int) -> DataFrame:
    """rows, of which there are `number`, grouped into units of about UNIT rows; all rows of one value of `by` are in one unit."""
    return rows.groupBy(F.pmod(F.xxhash64(*by), F.lit(max(1, -(-number // UNIT)))).alias("unit"))


def _shape(rows: DataFrame) -> DataFrame:
    """Of each group (of rows group, node, label) with several labels: its largest label, and the nodes in and outside of it."""
    per = rows.groupBy("group", "label").agg(F.count("*").alias("n"))
    return per.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.max("n").alias("inside"), F.sum("n").alias("n")).filter("n > inside").select("group", "major", "inside", (F.col("n") - F.col("inside")).alias("outside"))


def _blocked(rows: DataFrame, shape: DataFrame) -> DataFrame:
    """rows once for each unit (group, cross, x, y) that they are compared in.

    cross: block x of the nodes outside of the largest label with block y of those inside; else blocks x and y of the
    nodes outside. The largest label is never compared with itself.
    """
    blocks = shape.select("group", "major", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(f"{c}_blocks") for c in ("inside", "outside")))
    rows = rows.join(blocks, "group").withColumn("big", F.col("label") == F.col("major"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("big"), F.col("inside_blocks")).otherwise(F.col("outside_blocks"))).cast("int"))

    def to(last: str) -> Column:
        return F.sequence(F.lit(0), F.col(last) - 1)

    def unit(cross: bool, x: Column, y: Column) -> Column:
        return F.struct(F.lit(cross).alias("cross"), x.alias("x"), y.alias("y"))

    block = F.col("block")
    inside = F.transform(to("outside_blocks"), lambda x: unit(True, x, block))
    outside = F.concat(F.transform(to("inside_blocks"), lambda y: unit(True, block, y)), F.transform(to("outside_blocks"), lambda o: unit(False, F.least(block, o), F.greatest(block, o))))
    rows = rows.withColumn("unit", F.explode(F.when(F.col("big"), inside).otherwise(outside)))
    return rows.select("group", "node", "label", "big", "block", "unit.cross", "unit.x", "unit.y")


#: What tells units apart.
_UNIT = ["group", "cross", "x", "y"]


def _sides(col: dict[str, np.ndarray], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a unit's two sides; the same array if a block meets itself."""
    at = np.arange(lo, hi)
    if col["cross"][lo]:
        return at[~col["big"][at]], at[col["big"][at]]
    x, y = col["x"][lo], col["y"][lo]
    return (at, at) if x == y else (at[col["block"][at] == x], at[col["block"][at] == y])


def _pivot_pairs(prefix: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node with that pivot of its postings with which it collides most."""
    pairs = prefix.filter("node <> pivot").select("pivot", "node").distinct()
    sides = nodes.select("node", "sig", "n_shingles")
    both = pairs.join(sides, "node").join(sides.select(F.col("node").alias("pivot"), F.col("sig").alias("sig_p"), F.col("n_shingles").alias("n_p")), "pivot")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "<u4").reshape(-1, COORDINATES) for c in ("sig", "sig_p"))
            hits = (a == b).sum(1)
            x, y = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("n_shingles", "n_p"))
            ok = pa.array((hits >= MATCHES) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)))
            yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("pivot"), pa.array(hits)], names=["a", "b", "hits"]).filter(ok)

    found = both.mapInArrow(task, "a long, b long, hits long")
    return found.groupBy("a").agg(F.max_by("b", F.struct("hits", -F.col("b"))).alias("b"))


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets reach the similarity. A b with many a's is tried in chunks."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sides = texts.select(F.col("node").alias("a"), "text")
    left = pairs.join(many, "b").withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int")).join(sides, "a").select("b", "chunk", "a", "text")
    right = many.join(texts.select(F.col("node").alias("b"), "text"), "b").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = right.select("b", "chunk", F.col("b").alias("a"), "text")

    def unit(table: pa.Table) -> pa.Table:
        table, runs = _groups(table, ["b", "chunk"])
        b, a, text = table.column("b").to_numpy(), table.column("a").to_numpy(), table.column("text")
        out: list[tuple[int, int]] = []
        for lo, hi in runs:
            mine = next(i for i in range(lo, hi) if a[i] == b[i])
            y = shingles(text[mine].as_py(), n)
            for i in range(lo, hi):
                if a[i] != b[i]:
                    x = shingles(text[i].as_py(), n)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * shared >= percent * (len(x) + len(y) - shared):
                        out.append((int(a[i]), int(b[i])))
        _forget()
        cols = list(zip(*out, strict=True)) or [[], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return _units(left.unionByName(right), ["b", "chunk"], 2 * pairs.count()).applyInArrow(unit, "a long, b long")


def _met(lists: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """(group, node, label, big, block, cross, x, y) of all units in which nodes of different components must be compared, and their number."""
    rows = _prefix(lists).select(F.col("key").alias("group"), "node").join(labels, "node", "left").select("group", "node", F.coalesce("component", "node").alias("label"))
    shape, _ = _common.written(_shape(rows), "posting-shapes")
    met, _ = _common.written(_blocked(rows, shape), "mixed")
    return met, met.count()


def _in_question(lists: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(node, label, root): nodes that may link into another component; root joins the components that may be linked."""
    met, number = _met(lists, labels)
    rows = met.join(nodes.select("node", "sig", "n_shingles"), "node")

    def unit(table: pa.Table) -> pa.Table:
        table, runs = _groups(table, _UNIT)
        col = {c: table.column(c).to_numpy() for c in ("cross", "x", "y", "node", "label", "n_shingles", "block", "big")}
        sig = _sigs(table.column("sig"))
        names, at_name = np.unique(col["label"], return_inverse=True)
        union, flagged = _Union(len(names)), np.zeros(len(table), bool)
        for lo, hi in runs:
            left, right = _sides(col, lo, hi)
            if not len(left) or not len(right):
                continue
            _, ok = _possible(sig[left], sig[right], col["n_shingles"][left], col["n_shingles"][right], percent)
            ok &= col["label"][left][:, None] != col["label"][right][None, :]
            i, j = np.nonzero(ok)
            flagged[left[i]] = flagged[right[j]] = True
            for p, q in np.unique(np.stack([at_name[left[i]], at_name[right[j]]], 1), axis=0).tolist():
                union.join(p, q)
        rows_ = np.unique(np.stack([col["node"][flagged], at_name[flagged]], 1), axis=0) if flagged.any() else np.zeros((0, 2), np.int64)
        root = np.array([union.find(p) for p in rows_[:, 1].tolist()], np.int64)
        return pa.table({"node": pa.array(rows_[:, 0], pa.int64()), "label": pa.array(names[rows_[:, 1]], pa.int64()), "root": pa.array(names[root], pa.int64())})

    found = _units(rows, _UNIT, number).applyInArrow(unit, "node long, label long, root long").distinct()
    return _common.written(found, "question")[0]


def _family_links(question: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): stars of confirmed links between different components, each family compared in blocks."""
    family = components(question.select(F.col("label").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("label"), F.col("component").alias("family"))
    members, _ = _common.written(question.select("node", "label").distinct().join(family, "label").withColumnRenamed("family", "group"), "members")
    met, _ = _common.written(_blocked(members, _shape(members)), "family-blocks")
    rows = met.join(nodes.select("node", "sig", "n_shingles"), "node").join(texts, "node")

    def unit(table: pa.Table) -> pa.Table:
        table, runs = _groups(table, _UNIT)
        col = {c: table.column(c).to_numpy() for c in ("cross", "x", "y", "node", "label", "n_shingles", "block", "big")}
        sig, text = _sigs(table.column("sig")), table.column("text")
        out: list[tuple[int, int]] = []
        for lo, hi in runs:
            left, right = _sides(col, lo, hi)
            if not len(left) or not len(right):
                continue
            hits, ok = _possible(sig[left], sig[right], col["n_shingles"][left], col["n_shingles"][right], percent)
            ok &= col["label"][left][:, None] != col["label"][right][None, :]
            if left is right:
                ok &= left[:, None] < left[None, :]
            use = np.unique(np.concatenate([left[ok.any(1)], right[ok.any(0)]]))
            if not len(use):
                continue
            # the block's shingles, numbered
            sets = [shingles(text[i].as_py(), n) for i in use.tolist()]
            numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
            cut = np.cumsum([0, *map(len, sets)])
            place = {i: k for k, i in enumerate(use.tolist())}
            _, name = np.unique(col["label"][lo:hi], return_inverse=True)
            union = _Union(int(name.max()) + 1)
            mark = np.zeros(int(numbers.max()) + 1, bool)
            for r in np.flatnonzero(ok.any(1)).tolist():
                i = int(left[r])
                mine = numbers[cut[place[i]] : cut[place[i] + 1]]
                mark[mine] = True
                near = np.flatnonzero(ok[r])
                for q in near[np.argsort(-hits[r, near], kind="stable")].tolist():
                    j = int(right[q])
                    if union.find(int(name[i - lo])) != union.find(int(name[j - lo])):
                        theirs = numbers[cut[place[j]] : cut[place[j] + 1]]
                        shared = int(mark[theirs].sum())
                        if 100 * shared >= percent * (len(mine) + len(theirs) - shared):
                            union.join(int(name[i - lo]), int(name[j - lo]))
                            out.append((int(col["node"][i]), int(col["node"][j])))
                mark[mine] = False
        _forget()
        cols = list(zip(*out, strict=True)) or [[], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return _units(rows, _UNIT, met.count()).applyInArrow(unit, "a long, b long")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int, once: bool) -> DataFrame:
    """(node, text) of the wanted nodes; once: no rid repeats."""
    some, _ = _common.written(nodes.join(wanted.distinct(), "node", "left_semi").select("node", "rid", "fp"), "wanted")
    rows = docs.filter("text is not null").select(_rid(), "text").join(some, "rid").select("node", "text", "fp")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an id may repeat with other texts: those have another set
        for r in batches:
            same = [xxhash.xxh3_128_digest(shingles(t.as_py(), n).tobytes()) == f.as_py() for t, f in zip(r.column(1), r.column(2), strict=True)]
            yield r.select(["node", "text"]).filter(pa.array(same, pa.bool_()))

    return rows.drop("fp") if once else rows.mapInArrow(own, "node long, text string").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    _common.prepare(spark)
    signed, _ = _common.written(_signed(docs, n), "signed")
    once = signed.groupBy("rid").count().filter("count > 1").isEmpty()
    grouped = signed.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("rid").alias("rid"), F.max("sig").alias("sig"), F.max("n_shingles").alias("n_shingles"))
    nodes, _ = _common.written(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # below 100 / (100 - percent) - 1 shingles, only equal sets reach the similarity
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    lists, _ = _common.written(_lists(nodes.filter(F.col("n_shingles") >= least)), "lists")

    tried, _ = _common.written(_pivot_pairs(_prefix(lists), nodes, percent), "pivots")
    wanted = tried.select(F.col("a").alias("node")).union(tried.select("b"))
    links, _ = _common.written(_confirmed(tried, _texts(docs, nodes, wanted, n, once), n, percent), "links")
    labels, _ = _common.written(components(links), "labels")
    question = _in_question(lists, nodes, labels, percent)
    if not question.isEmpty():
        more = _family_links(question, nodes, _texts(docs, nodes, question.select("node"), n, once), n, percent)
        links, _ = _common.written(links.unionByName(more), "links")
        labels, _ = _common.written(components(links), "labels")

    named = nodes.select("fp", "node", "rep").join(labels, "node", "left").select("fp", "rep", F.coalesce("component", "node").alias("component"))
    named, _ = _common.written(named, "named")
    first = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(first, "component").select("fp", "component_id")
    out = signed.join(named, "fp", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
