"""Near-duplicate embeddings by lattice hashing on E8.

In each of several tables a random projection takes the unit vectors to eight dimensions,
where the nearest point of the E8 lattice (decoded exactly, as the better of two cosets of D8)
names the cell. A vector is indexed under its own cell and under the cells of its next nearest
lattice points, so vectors meet when their neighbourhoods touch. Meeting pairs of one label are
verified by cosine in double precision.

Equal vectors of one label form one class with a multiplicity, so copies are never paired. Of
each cell only spanning edges leave the task. Once components are known, links are counted
exactly inside each component, where all of them lie, by blocks of members against blocks: no
partner is capped, and no task holds more than two blocks. A member is copied once per block of its
component, and blocks are as large as memory allows, but for those needed to give every task some.

Defined cases: rows whose label or vector is null, whose vector is zero, or holds a null or a
value that isn't finite link with nothing, and so do rows without an id; vectors of different
lengths never link; rows that repeat, in all or in the id alone, count as separate vectors; other columns
don't come through, so none can clash; an empty table gives an empty result.

With the defaults, two vectors at the threshold 0.93 meet in one of the tables with a
probability over 0.999 (measured in the tests), closer ones more surely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from visitframe.llm.common import _runs, checkpoint, connected_components, hot_join, linked_runs, pair_positions, partitions

THRESHOLD = 0.93
TABLES = 5
PROBES = 3
#: Projected length of the difference of two vectors at the threshold, in lattice units.
REACH = 0.7
#: Numbers in the vectors of the largest block whose members meet those of another in one task, and
#: members that are compared at once.
BLOCK_NUMBERS, TILE = 1 << 21, 1024


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates and an even sum."""
    f = np.rint(y)
    off = y - f
    odd = np.flatnonzero(f.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    f[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return f


def lattice_cells(y: np.ndarray, probes: int) -> np.ndarray:
    """n x (1 + probes) x 8: twice the nearest lattice points, nearest first. Candidates are
    the nearest point of each coset of D8 and, of each, those with two of its three least
    certain coordinates moved to their other side."""
    found = []
    for shift in (0.0, 0.5):
        base = _nearest_d8(y - shift) + shift
        found.append(base)
        off = y - base
        least = np.argsort(-np.abs(off), axis=1, kind="stable")[:, :3]
        row = np.arange(len(y))
        move = np.where(off >= 0, 1.0, -1.0)
        for i, j in ((0, 1), (0, 2), (1, 2)):
            other = base.copy()
            for k in (i, j):
                other[row, least[:, k]] += move[row, least[:, k]]
            found.append(other)
    points = np.stack(found, axis=1)
    away = ((points - y[:, None, :]) ** 2).sum(axis=2)
    order = np.argsort(away, axis=1, kind="stable")[:, : 1 + probes]
    return np.rint(2 * np.take_along_axis(points, order[:, :, None], axis=1)).astype(np.int64)


def projections(dim: int, tables: int, seed: int) -> np.ndarray:
    """tables x dim x 8 random orthonormal projections (Gaussian where dim < 8)."""
    rng = np.random.default_rng(seed)
    return np.stack(
        [np.linalg.qr(m)[0] if dim >= 8 else m for m in (rng.standard_normal((dim, 8)) for _ in range(tables))]
    )


def _keys(label: np.ndarray, table: int, cells: np.ndarray) -> np.ndarray:
    h = label.view(np.uint64) ^ np.uint64(table + 1)
    with np.errstate(over="ignore"):
        for k in range(cells.shape[1]):
            h = (h ^ cells[:, k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h.view(np.int64)


def vector_matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list array (all of one length, no nulls) as float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(label: str, vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(
        F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False)
    )


def _index(classes: DataFrame, threshold: float, tables: int, probes: int, seed: int, kind: str) -> DataFrame:
    """(key, node, label, vector): every class under its cells in every table. classes has
    node, label (long), vector (array<double>); the index holds it as bytes of dtype kind."""
    step = np.sqrt(2 - 2 * threshold) / REACH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                node, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(lengths):
                    at = np.flatnonzero(lengths == dim)
                    raw = vector_matrix(batch.column(2).take(pa.array(at)))
                    stored = pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary())
                    u = unit(raw)
                    if dim not in kept:
                        kept[dim] = projections(int(dim), tables, seed) * (np.sqrt(max(dim, 8) / 8) / step)
                    for t in range(tables):
                        cells = lattice_cells(u @ kept[dim][t], probes)
                        for p in range(1 + probes):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(_keys(label[at], t * 1000 + int(dim) * 64000, cells[:, p])), pa.array(node[at]), pa.array(label[at]), stored],
                                names=["key", "node", "label", "vector"],
                            )

    return classes.select("node", "label", "vector").mapInArrow(run, "key long, node long, label long, vector binary")


def _cosine_linker(threshold: float, kind: str):
    def link(cols: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        v = unit(cols["vector"].view(kind).astype(np.float64))
        label = cols["label"]
        small = starts[1:] - starts[:-1] <= 32
        runs = np.flatnonzero(~small)
        for r in runs:
            lo, hi = starts[r], starts[r + 1]
            for a in range(lo, hi, 1024):
                for b in range(a, hi, 1024):
                    near = v[a : min(a + 1024, hi)] @ v[b : min(b + 1024, hi)].T >= threshold
                    i, j = np.nonzero(near)
                    i, j = i + a, j + b
                    ok = (i < j) & (label[i] == label[j])
                    yield i[ok], j[ok]
        rows = np.repeat(small, starts[1:] - starts[:-1])
        at = np.flatnonzero(rows)
        sizes = (starts[1:] - starts[:-1])[small]
        for i, j in pair_positions(np.concatenate([[0], np.cumsum(sizes)]), 1 << 16):
            i, j = at[i], at[j]
            near = (np.einsum("ij,ij->i", v[i], v[j]) >= threshold) & (label[i] == label[j])
            yield i[near], j[near]

    return link


def block_count(size: Column, dim: Column, tasks: int) -> Column:
    """Blocks of a component: enough for memory, and for some pairs of blocks per task, but no block
    below a tile."""
    fits = F.ceil(size * dim / F.lit(BLOCK_NUMBERS))
    shared = F.lit(math.ceil(math.sqrt(8 * tasks)))
    return F.greatest(F.least(F.ceil(size / F.lit(TILE)), F.greatest(fits, shared)), F.lit(1)).cast("int")


def _count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): links of each class to the others of its component, copies counted.
    members: component, node, copies, vector."""
    spark = members.sparkSession
    sizes = members.groupBy("component").agg(F.count("*").alias("__size"), F.max(F.size("vector")).alias("__dim"))
    blocks = block_count(F.col("__size"), F.col("__dim"), partitions(spark))
    spread = (
        members.join(sizes, "component")
        .withColumn("__blocks", blocks)
        .withColumn("__own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("__blocks")).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        .select(
            F.xxhash64("component", F.least("__own", "__other"), F.greatest("__own", "__other")).alias("key"),
            "component",
            F.col("__own").alias("own"),
            F.col("__other").alias("other"),
            "node",
            "copies",
            "vector",
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _runs(batches, 1 << 62):
            key, own, other, node, copies = (
                t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "own", "other", "node", "copies")
            )
            component = t["component"].combine_chunks().to_numpy(zero_copy_only=False)
            # two components in one key (a hash collision) stay apart
            parted = np.flatnonzero((key[1:] != key[:-1]) | (component[1:] != component[:-1])) + 1
            starts = np.concatenate([[0], parted, [len(key)]])
            vectors = t["vector"].combine_chunks()
            out_node, out_links = [], []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                v = unit(vector_matrix(vectors.slice(lo, hi - lo)))
                n, c, o = node[lo:hi], copies[lo:hi], own[lo:hi]
                same = own[lo] == other[lo]
                sides = [np.arange(hi - lo)] * 2 if same else [np.flatnonzero(o == s) for s in np.unique(o)]
                if len(sides) < 2:
                    continue
                a, b = sides
                links = np.zeros(hi - lo, np.int64)
                for x in range(0, len(a), TILE):
                    i = a[x : x + TILE]
                    for y in range(0, len(b), TILE):
                        j = b[y : y + TILE]
                        near = v[i] @ v[j].T >= threshold
                        if same and x == y:
                            np.fill_diagonal(near, False)
                        links[i] += near @ c[j]
                        if not same:
                            links[j] += near.T @ c[i]
                out_node.append(n)
                out_links.append(links)
            if out_node:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_node)), pa.array(np.concatenate(out_links).astype(np.int64))],
                    names=["node", "links"],
                )

    dealt = spread.repartition(partitions(spark), "key").sortWithinPartitions("key", "component")
    return dealt.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_neighbors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    probes: int = PROBES,
    seed: int = 8,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors; ids are integers."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("__id"), F.col(label).alias("__label"), F.col(vector).alias("__vec")
    ).withColumn("__fine", usable("__label", "__vec") & F.col("__id").isNotNull())
    fine = rows.where("__fine").select(
        "__id",
        F.xxhash64("__label").alias("label"),
        F.xxhash64("__label", "__vec").alias("k1"),
        F.xxhash64(F.lit("second"), "__label", "__vec").alias("k2"),
        F.col("__vec").cast("array<double>").alias("vector"),
    )
    classes = checkpoint(
        fine.groupBy("k1", "k2").agg(
            F.min("__id").alias("first_id"),
            F.count("*").alias("copies"),
            F.first("label").alias("label"),
            F.first("vector").alias("vector"),
        ).withColumn("node", F.monotonically_increasing_id())
    )
    # floats are doubles' values in half the bytes
    kind = "<f4" if vectors.schema[vector].dataType.elementType == FloatType() else "<f8"
    edges = linked_runs(_index(classes, threshold, tables, probes, seed, kind), _cosine_linker(threshold, kind))
    parts = checkpoint(connected_components(edges))
    members = classes.join(parts, "node").select("component", "node", "first_id", "copies", "vector")
    named = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    links = _count_links(members, threshold)
    by_class = (
        classes.select("k1", "k2", "node", "first_id", "copies")
        .join(parts.join(named, "component"), "node", "left")
        .join(links, "node", "left")
        .select(
            "k1",
            "k2",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "first_id").alias("component_id"),
            "copies",
        )
    )
    # copies of one vector are as many rows of one class; those of hot ones are dealt over all tasks
    linked = hot_join(fine.select("__id", "k1", "k2"), checkpoint(by_class), ["k1", "k2"], ["__id"], rows="copies").select(
        "__id", "n_links", "component_id"
    )
    alone = rows.where("not __fine").select(
        "__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id")
    )
    return linked.unionByName(alone).select(
        F.col("__id").alias(id_col),
        "n_links",
        "component_id",
        F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def op10_e8_neighbors(vectors: DataFrame) -> DataFrame:
    return near_neighbors(vectors)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS low FROM v UNION SELECT p.y, r.low FROM r JOIN p ON p.x = r.node WHERE r.low < p.y),
c AS (SELECT node, min(low) AS low FROM r GROUP BY node),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.low, e.vec_id)::BIGINT AS component_id,
       coalesce(c.low, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""
