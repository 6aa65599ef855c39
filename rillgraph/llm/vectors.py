"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative kept.

Equal vectors become one node with a count, so exact copies are never compared. Centres are fitted on a bounded
sample (SAMPLE vectors at most; every vector is indexed). Each vector is at home in its nearest cell. Cells are dealt
to regions of about REGION vectors, and a vector visits each region with a cell that can hold a partner: partners of
cell c are nearer to c than to the vector's own centre h, and by the triangle inequality no vector there reaches cosine t
if x.(h - c) / |h - c| > sqrt(1 - t^2). In a region the same test tells, cell by cell, which residents it is compared with.
No pair is missed, whatever the data. Groups far apart never meet; vectors in random directions meet nearly all cells, so
there the work grows with the square of their number.

Of two regions one is visited by the other's vectors, so that each pair is counted once. Regions are cut into units of
REGION residents and REGION visitors, compared in products of at most BLOCK x BLOCK in double precision, whatever the
region's size. A unit returns link counts per vector and the edges of its components' stars, never its pairs.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, each a component
of its own; vectors of different length never link. Null ids: such a vector links and counts as others do; it names no
component unless all ids of it are null, and then the component's id is null. Repeated rows link with each other as copies. Cosines within
1e-12 of the threshold are summed again exactly. Labels and extra columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from rillgraph.llm import _common
from rillgraph.llm.components import components

#: Vectors that centres are fitted on, at most.
SAMPLE = 16_384
#: Residents of a cell, about, up to MAX_CELLS cells of a length: beyond that cells grow and tell less apart, and every
#: pair that may link is still compared.
CELL = 200
MAX_CELLS = 4096
#: Vectors of a region, about, and of each side of one unit.
REGION = 8192
BLOCK = 1024
ROUNDS = 6


def usable(vector: str = "embedding") -> Column:
    """Whether a vector can have a cosine: components there and finite, not all zero; never null."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _rows(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of equal length as the rows of a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: k unit centres. Empty cells keep their centre."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(sample[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(sample), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, home, sample)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def _nodes(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, dim, bytes) of the usable vectors; bytes are the components in their own precision."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = [np.asarray(x.values.to_numpy(zero_copy_only=False), kind) + 0.0 for x in rows.column(1)]  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(m) for m in made], pa.int32()), pa.array([m.tobytes() for m in made], pa.binary())], names=["vec_id", "dim", "bytes"])

    flat = vectors.filter(usable()).select("vec_id", F.col("embedding").cast("array<double>"))
    return flat.mapInArrow(task, "vec_id long, dim int, bytes binary")


def _compare(q: np.ndarray, h: np.ndarray, raw: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows of q and h that reach the threshold."""
    cos = q @ h.T
    i, j = np.nonzero(cos >= threshold - 1e-12)
    ok = np.ones(len(i), bool)
    for n in np.flatnonzero(cos[i, j] < threshold + 1e-12):
        a, b = raw[0][i[n]], raw[1][j[n]]
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        ok[n] = math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)) >= threshold
    return i[ok], j[ok]


def _near(own: np.ndarray, cos: np.ndarray, between: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a cell can hold a partner, from a vector's cosines with its home's centre and with the cell's, and that between both centres."""
    reach = math.sqrt(1 - min(threshold, 1) ** 2) if threshold > 0 else 2.0
    return own[:, None] - cos <= reach * np.sqrt(np.maximum(2 - 2 * between, 0)) + 1e-6


def regions_met(x: np.ndarray, c: np.ndarray, region: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home region of each row of x, whether it visits each region); of two regions, one is visited by the other's rows."""
    return _met(x, c, region, threshold)[1:]


def _met(x: np.ndarray, c: np.ndarray, region: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home cell of each row of x, and its regions_met."""
    cos = x @ c.T
    home = cos.argmax(1)
    near = _near(cos[np.arange(len(x)), home], cos, (c @ c.T)[home], threshold)
    own, at = region[home], np.arange(int(region.max()) + 1)
    visits = np.stack([near[:, region == g].any(1) for g in at], 1)
    goes = (own[:, None] < at) ^ ((own[:, None] + at) % 2 == 1)
    return home, own, (visits & goes & (own[:, None] != at)) | (own[:, None] == at)


def products(x: np.ndarray, home: np.ndarray, cell: np.ndarray, c: np.ndarray | None, threshold: float, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (rows of x, residents) to compare: each resident, of cell `cell`, meets each row whose home allows it a partner in that cell.

    Rows are taken in the order of their homes, so those of a block agree on most cells. Cells that a whole block meets are one product's
    side, others are compared cell by cell. c None: there is one cell only.
    """
    order, sides = np.argsort(home, kind="stable"), np.argsort(cell, kind="stable")
    cells, begin = np.unique(cell[sides], return_index=True)
    members = np.split(sides, begin[1:])
    for y in range(0, len(order), block):
        rows = order[y : y + block]
        met = [(rows, sides)]
        if c is not None:
            at = c[home[rows]]
            near = _near((x[rows] * at).sum(1), x[rows] @ c[cells].T, at @ c[cells].T, threshold)
            every = near.all(0)
            met = [(rows[near[:, n]], members[n]) for n in np.flatnonzero(near.any(0) & ~every)]
            if every.any():
                met.append((rows, np.concatenate([members[n] for n in np.flatnonzero(every)])))
        for some, side in met:
            for z in range(0, len(side), block):
                yield some, side[z : z + block]


def _stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the edges x - y of one block."""
    ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def near_vectors(vectors: DataFrame, threshold: float = 0.9, cell: int = CELL, region: int = REGION) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    _common.prepare(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kind = "<f4" if rows.schema["embedding"].dataType == ArrayType(FloatType()) else "<f8"
    flat, _ = _common.written(_nodes(rows, kind), "vectors")
    grouped = flat.groupBy("bytes").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.max("dim").alias("dim"))
    nodes, _ = _common.written(grouped.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")

    # vectors of different length never link: each length has centres, cells and regions of its own
    lengths = sorted((r["dim"], r["count"]) for r in nodes.groupBy("dim").count().collect())
    plans, first_region = {}, 0
    for dim, total in lengths:
        k = max(1, min(MAX_CELLS, total // cell))
        c = of = None
        if k > 1:
            some = nodes.filter(F.col("dim") == dim).orderBy(F.xxhash64("bytes"), "node").limit(SAMPLE).select("bytes").toArrow()
            c = centres(_unit(_rows(some.column(0), kind)), k)
            # cells whose centres are near each other form a region
            of = np.unique((c @ centres(c, min(k, -(-total // region))).T).argmax(1), return_inverse=True)[1]
        plans[dim] = (c, of, first_region)
        first_region += int(of.max()) + 1 if k > 1 else 1
    shared = spark.sparkContext.broadcast(plans)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            home, cells, visits = np.zeros(r.num_rows, np.int32), np.zeros(r.num_rows, np.int32), [None] * r.num_rows
            dims = r.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                c, of, start = shared.value[dim]
                at = np.flatnonzero(dims == dim)
                if c is None:
                    own, met = np.zeros(len(at), np.int64), np.ones((len(at), 1), bool)
                else:
                    cells[at], own, met = _met(_unit(_rows(r.column(1).take(pa.array(at)), kind)), c, of, threshold)
                home[at] = own + start
                for i, m in zip(at.tolist(), met, strict=True):
                    visits[i] = (np.flatnonzero(m) + start).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*r.columns, pa.array(home), pa.array(cells), pa.array(visits, pa.list_(pa.int32()))], names=[*r.schema.names, "home", "cell", "visits"])

    placed = nodes.select("node", "bytes", "dim", "copies").mapInArrow(place, "node long, bytes binary, dim int, copies long, home int, cell int, visits array<int>")
    placed, _ = _common.written(placed, "vector-regions")
    # one row per region with its residents' and visitors' numbers; broadcast below Spark's own limit only
    residents = placed.groupBy("home").agg(F.count("*").alias("r")).select(F.col("home").alias("region"), F.ceil(F.col("r") / region).cast("int").alias("rb"))
    visitors = placed.select(F.explode("visits").alias("region")).groupBy("region").agg(F.count("*").alias("v")).select("region", F.ceil(F.col("v") / region).cast("int").alias("vb"))
    blocks, _ = _common.written(residents.join(visitors, "region"), "vector-blocks")
    salt = F.xxhash64("node")
    base = ["region", "node", "bytes", "dim", "copies", "home", "cell"]
    homes = placed.withColumn("region", F.col("home")).join(blocks, "region").withColumn("hb", F.pmod(salt, "rb").cast("int"))
    homes = homes.withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))).select(*base, "hb", "vb", F.lit(True).alias("resident"))
    guests = placed.withColumn("region", F.explode("visits")).join(blocks, "region").withColumn("vb", F.pmod(salt, "vb").cast("int"))
    guests = guests.withColumn("hb", F.explode(F.sequence(F.lit(0), F.col("rb") - 1))).select(*base, "hb", "vb", F.lit(False).alias("resident"))

    def unit(t: pa.Table) -> pa.Table:
        here = t.column("region")[0].as_py()
        t = t.combine_chunks()
        ids, at = np.unique(t.column("node").to_numpy(), return_inverse=True)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        dim, resident, stays = t.column("dim").to_numpy(), t.column("resident").to_numpy(), t.column("home").to_numpy() == here
        copies, cell, column = t.column("copies").to_numpy(), t.column("cell").to_numpy(), t.column("bytes")
        for d in np.unique(dim):
            q, h = (np.flatnonzero((dim == d) & (resident == r)) for r in (False, True))
            if not len(q) or not len(h):
                continue
            raw_q, raw_h = _rows(column.take(pa.array(q)), kind), _rows(column.take(pa.array(h)), kind)
            unit_q, unit_h = _unit(raw_q), _unit(raw_h)
            for y, z in products(unit_q, cell[q], cell[h], shared.value[int(d)][0], threshold):
                i, j = _compare(unit_q[y], unit_h[z], (raw_q[y], raw_h[z]), threshold)
                i, j = q[y[i]], h[z[j]]
                # residents meet each other both as visitors and at home
                once = ~stays[i] | (at[i] < at[j])
                i, j = i[once], j[once]
                if not len(i):
                    continue
                links += (np.bincount(at[i], copies[j], len(ids)) + np.bincount(at[j], copies[i], len(ids))).astype(np.int64)
                a, b = root[at[i]], root[at[j]]
                if (a != b).any():
                    some, low = _stars(a[a != b], b[a != b])
                    to = np.arange(len(ids))
                    to[some] = low
                    root = to[root]
        use = links > 0
        return pa.table({"node": pa.array(ids[use], pa.int64()), "root": pa.array(ids[root[use]], pa.int64()), "links": pa.array(links[use])})

    found = homes.unionByName(guests).groupBy("region", "hb", "vb").applyInArrow(unit, "node long, root long, links long")
    found, _ = _common.written(found, "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))

    named = nodes.select("node", "bytes", "rep", "copies").join(links, "node", "left").join(labels, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node")).withColumn("n", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    named, _ = _common.written(named.select("bytes", "rep", "component", "n"), "vector-named")
    first = named.groupBy("component").agg(F.min("rep").alias("first"))
    named = named.join(first, "component").select("bytes", "n", "first")
    linked = flat.join(named, "bytes").select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("first").alias("component_id"))
    # the rest: rows without a usable vector
    rest = rows.select("vec_id", "embedding").filter(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

