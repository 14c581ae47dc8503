"""Exact nearest rows in many dimensions: blocks of rows meet, a matrix product rules nearly all pairs out, the others are compared in full.

In many dimensions no pivot rules a row out, so all pairs are looked at; what counts is what a pair costs. `Bound` maps rows to vectors whose
products bound distances from below. Rows travel packed, a block in a row, and pairs of blocks are met where they lie: no row is copied
per pair of blocks in a shuffle, and a task holds one pair of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.session import materialize

#: Rows of a block of queries and of base rows at most, and queries at least, unless there are fewer.
QUERY_BLOCK, BASE_BLOCK, LEAST_BLOCK = 8192, 32_768, 512
#: Blocks of queries that a small table is cut to, so that all cores have some.
QUERY_BLOCKS = 32
#: sum of a * (1 - cos(w * d)) over these (w, a) is at most |d| for every d, and 0.9 of its mean where d is normal with variance 1.
WAVES = ((1.35, 0.978), (3.915, 0.1359))


class Bound:
    """Rows as float32 vectors. `product(query, base) < need(queries, reach)` rules a pair out: it is farther apart than reach.

    euclidean: half the square of a distance is half the squares of both lengths less their product. gower: a feature's gap is at
    least a sum of 1 - cos(w * gap), which are products of sines and cosines; categories differ if their bins do."""

    def __init__(self, metric: str, flags: np.ndarray, scale: np.ndarray, middle: np.ndarray, spread: np.ndarray):
        self.metric, self.flags, self.scale, self.middle = metric, flags, scale, middle
        self.bins = int(np.clip(256 // max(flags.sum(), 1), 2, 16))
        self.own = np.nonzero(~flags & (spread > 0) & np.isfinite(spread))[0]
        gap = math.sqrt(2) * spread[self.own]
        self.turns = [w / gap for w, _ in WAVES]
        self.sizes = [a * gap / scale[self.own] for _, a in WAVES]
        self.most = float(sum(s.sum() for s in self.sizes) + flags.sum())

    def mapped(self, x: np.ndarray) -> np.ndarray:
        if self.metric == "euclidean":
            return (x - self.middle).astype(np.float32)
        at = (x - self.middle)[:, self.own]
        parts = []
        for turn, size in zip(self.turns, self.sizes, strict=True):
            angle, root = at * (turn / (2 * math.pi)), np.sqrt(size).astype(np.float32)
            angle = ((angle - np.rint(angle)) * (2 * math.pi)).astype(np.float32)  # in doubles it may be many turns
            parts += [np.cos(angle) * root, np.sin(angle) * root]
        for f in np.nonzero(self.flags)[0]:
            parts.append(np.mod(np.floor(x[:, f]), self.bins)[:, None] == np.arange(self.bins))
        return np.concatenate([np.empty((len(x), 0), np.float32), *[p.astype(np.float32, copy=False) for p in parts]], axis=1)

    def base(self, x: np.ndarray) -> np.ndarray:
        v = self.mapped(x)
        lost = (v * v).sum(axis=1) / 2 if self.metric == "euclidean" else np.zeros(len(v))
        return np.column_stack([v, -lost.astype(np.float32)])

    def query(self, x: np.ndarray) -> np.ndarray:
        v = self.mapped(x)
        return np.column_stack([v, np.ones(len(v), np.float32)])

    def need(self, query: np.ndarray, longest: float, reach: np.ndarray) -> np.ndarray:
        """longest: the largest square of a base row's length. Products of float32 get room for what they round off."""
        if self.metric == "euclidean":
            square = (query[:, :-1].astype(float) ** 2).sum(axis=1)
            room = (query.shape[1] + 8) * 2.0**-22 * (square + longest)
            return square / 2 - reach * reach / 2 * (1 + 1e-9) - room
        room = (query.shape[1] + 8) * 2.0**-22 * self.most
        return self.most - reach * len(self.flags) * (1 + 1e-9) - room

    def distance(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Row by row, in the order of the features, as a column expression adds them up; squares for euclidean."""
        if self.metric == "euclidean":
            return np.cumsum((u - v) * (u - v), axis=1)[:, -1]
        off = np.abs(u - v) / self.scale
        off[:, self.flags] = u[:, self.flags] != v[:, self.flags]
        return np.cumsum(off, axis=1)[:, -1] / len(self.flags)


def _first(rows: np.ndarray, keys: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's (key, at) the k smallest, in order."""
    order = np.lexsort((at, keys, rows))
    rows, keys, at = rows[order], keys[order], at[order]
    new = np.r_[True, rows[1:] != rows[:-1]]
    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    return rows[place < k], keys[place < k], at[place < k]


def nearest_of_blocks(bound: Bound, x: np.ndarray, base: np.ndarray, me: np.ndarray, k: int, by_square: bool, exact_at_once: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of x, keys, rows of base): the k nearest of each row; of equal keys the first row of base. me: a row of base that doesn't count, or -1.
    Keys are distances, or with by_square their squares."""
    root = bound.metric == "euclidean" and not by_square

    def compared(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for lo in range(0, len(rows), exact_at_once):
            part = slice(lo, lo + exact_at_once)
            out[part] = bound.distance(x[rows[part]], base[at[part]])
        return np.sqrt(out) if root else out

    mapped = bound.base(base)
    longest = float(-2 * mapped[:, -1].min()) if len(base) and bound.metric == "euclidean" else 0.0
    asks = bound.query(x)
    found = []
    for lo in range(0, len(x), 512):
        ask, mine = asks[lo : lo + 512], me[lo : lo + 512]
        rows, keys, at = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        reach = np.full(len(ask), np.inf)
        for first in range(0, len(base), 4096):
            product = ask @ mapped[first : first + 4096].T
            if first == 0:  # the k best by their bounds give a first reach, by the row itself a place more
                most = min(k + 1, product.shape[1])
                r = np.repeat(np.arange(len(ask)), most)
                a = np.argpartition(-product, most - 1, axis=1)[:, :most].ravel() if most < product.shape[1] else np.tile(np.arange(most), len(ask))
                r, a = r[a != mine[r]], a[a != mine[r]]
                reach = _reach(len(ask), *_first(r, compared(lo + r, a), a, k)[:2], k, by_square)
            need = bound.need(ask, longest, reach)
            # what isn't a number rules nothing out
            r, a = np.divmod(np.flatnonzero(~(product < need[:, None].astype(np.float32))), product.shape[1])
            a = a + first
            r, a = r[a != mine[r]], a[a != mine[r]]
            if len(r):
                new = compared(lo + r, a)
                rows, keys, at = _first(np.r_[rows, r], np.r_[keys, new], np.r_[at, a], k)
                reach = np.minimum(reach, _reach(len(ask), rows, keys, k, by_square))
        found.append((rows + lo, keys, at))
    return tuple(np.concatenate(c) if found else np.empty(0, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def _reach(n: int, rows: np.ndarray, keys: np.ndarray, k: int, by_square: bool) -> np.ndarray:
    """The k-th key of every row that has so many, as a distance."""
    out = np.full(n, np.inf)
    last = np.flatnonzero(np.r_[rows[1:] != rows[:-1], True]) if len(rows) else np.empty(0, np.int64)
    full = np.bincount(rows, minlength=n)[rows[last]] >= k
    out[rows[last][full]] = keys[last][full]
    return np.sqrt(out) * (1 + 1e-12) if by_square else out


def _packed(df: DataFrame, blocks: int, kind: str, copies: int | None) -> DataFrame:
    """(ids, x) a row per block: the ids in their order and the vectors one after the other. copies: of rows with the same vector only so
    many of a block stay."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        held = held.take(pc.sort_indices(held["id"])).combine_chunks()
        lists = held["x"].combine_chunks()
        x = np.asarray(lists.flatten(), float).reshape(len(lists), -1) + 0.0  # -0.0 and 0.0 are the same
        ids = held["id"].combine_chunks()
        if copies is not None:
            _, own = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
            rows, _, at = _first(own, np.zeros(len(x)), np.arange(len(x)), copies)
            kept = np.sort(at)
            x, ids = x[kept], ids.take(pa.array(kept))
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([lists, pa.array([x.tobytes()], pa.binary())], ["ids", "x"])

    dealt = df.repartitionById(blocks, F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int"))
    return dealt.mapInArrow(pack, f"ids array<{kind}>, x binary")


def nearest_in_grid(
    queries: DataFrame, base: DataFrame, id_col: str, features: Sequence[str], k: int, metric: str, flags: np.ndarray, scale: np.ndarray,
    same_id: bool = True, by_square: bool = False, query_block: int = QUERY_BLOCK, base_block: int = BASE_BLOCK,
) -> DataFrame:
    """(query_id, base_id, key): the k nearest rows of each block of base rows for every query; the k nearest of all are among them."""
    spark, kind, width = queries.sparkSession, dict(queries.dtypes)[id_col], len(features)
    packed = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    sides = [t.select(F.col(id_col).alias("id"), packed.alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))) for t in (queries, base)]
    # a row per feature reaches the driver
    by_place = sides[0].select("x", F.lit(1).alias("asks")).unionByName(sides[1].select("x", F.lit(0).alias("asks"))).select("asks", F.posexplode("x"))
    facts = by_place.groupBy("pos").agg(F.sum("asks").alias("asked"), F.count("*").alias("n"), F.avg("col").alias("middle"), F.stddev_pop("col").alias("spread"))
    stats = facts.orderBy("pos").collect()
    asked, met = (stats[0]["asked"], stats[0]["n"] - stats[0]["asked"]) if stats else (0, 0)
    schema = f"query_id {kind}, base_id {kind}, key double"
    if not asked or not met:
        return spark.createDataFrame([], schema)
    bound = Bound(metric, flags, scale, *(np.array([r[c] for r in stats]) for c in ("middle", "spread")))
    size = min(query_block, max(LEAST_BLOCK, -(-asked // QUERY_BLOCKS)))
    blocks = -(-asked // size), -(-met // base_block)
    asked, met = (materialize(_packed(t, n, kind, c)) for t, n, c in zip(sides, blocks, (None, k + 1), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (own, x), (ids, v) = ((batch[c][i].values, np.frombuffer(batch[c + 1][i].as_buffer()).reshape(-1, width)) for c in (0, 2))
                me = np.full(len(own), -1) if same_id else pc.fill_null(pc.index_in(own, value_set=ids), -1).to_numpy(zero_copy_only=False)
                rows, keys, at = nearest_of_blocks(bound, x, v, me, k, by_square)
                yield pa.RecordBatch.from_arrays([own.take(pa.array(rows)), ids.take(pa.array(at)), pa.array(keys, pa.float64())], ["query_id", "base_id", "key"])

    # a pair of blocks per task, read from where they are kept
    pairs = asked.crossJoin(met.withColumnsRenamed({"ids": "base_ids", "x": "v"}).hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(run, schema)
