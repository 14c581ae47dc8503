"""Pieces shared by the operators: checkpoints, prefix sums, linked runs, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest run of rows that one task compares at once; longer runs are cut into
#: chunks of this size and every pair of chunks becomes a row group of its own.
RUN_CHUNK = 1 << 14


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset a temporary
    folder serves on one machine; on a cluster that is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="visitframe-")
        sc.setCheckpointDir(root)
    return root


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the folder of spark.checkpoint.dir."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df written as a Parquet table under spark.checkpoint.dir, and read again."""
    spark = df.sparkSession
    root = shared_folder(spark)
    path = f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner") -> DataFrame:
    """big with the one row of small for each value of `on`. Both sides are dealt by a hash of
    big's `spread` as well, so that a value with a third of all rows goes to many tasks."""
    n = partitions(big.sparkSession)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return (
        big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(n)).cast("int")).join(salted, [*on, "__salt"], how).drop("__salt")
    )


#: Keys held as hot by hot_join at most; so many can each hold their share of all rows.
HOT_KEYS = 4096


def hot_join(
    big: DataFrame, counted: DataFrame, on: list[str], spread: list[str], rows: str = "n", total: int | None = None
) -> DataFrame:
    """Inner join of big with counted, one row per key `on` whose column `rows` says how many rows
    of big have it. Keys with over 1/HOT_KEYS of those rows are hot: there are HOT_KEYS at most,
    whatever the input, so the list of them is broadcast. Their rows are dealt over all tasks by a hash of
    `spread`; the others join by `on` alone and aren't replicated. counted is read twice; `total` is the sum of
    `rows`, where it is known."""
    n = partitions(big.sparkSession)
    if total is None:
        total = counted.agg(F.sum(rows)).first()[0] or 0
    bound = max(total // HOT_KEYS, 1000)
    hot = counted.where(F.col(rows) > bound).select(*on, F.lit(True).alias("__hot"))
    salts = F.when(F.col(rows) > bound, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(n)).cast("int")).otherwise(0)
    marked = big.join(F.broadcast(hot), on, "left").withColumn("__salt", salt).drop("__hot")
    return marked.join(counted.withColumn("__salt", F.explode(salts)), [*on, "__salt"]).drop("__salt")


def size_buckets(rows: int, per_bucket: int = 2000, least: int = 64, most: int = 16384) -> int:
    """Buckets for a two-level prefix sum: they grow with the rows, within a proven bound."""
    return max(least, min(most, rows // per_bucket))


def running_total(
    df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str
) -> DataFrame:
    """Add `out`: the sum of `value` up to and with each row, per `keys`, in the order
    of (`bucket`, *`order`).

    Two levels, so that no key is gathered in one task: sums per (keys, bucket),
    prefix sums over that small table, then a window inside each bucket. The join and
    the window share one exchange on (keys, bucket).
    """
    group = [*keys, bucket]
    sums = df.groupBy(*group).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"__{c}") for c in group],
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"),
    )
    on = F.lit(True)
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(offsets, on)
        .withColumn(out, F.col("__before") + F.sum(value).over(inside))
        .drop("__before", *[f"__{c}" for c in group])
    )


def text_slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """batch in slices whose texts have about `most` bytes; a longer text has one of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False) + 8)
    lo = 0
    while lo < batch.num_rows:
        reach = most + (ends[lo - 1] if lo else 0)
        hi = max(lo + 1, int(np.searchsorted(ends, reach, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


# ---------------------------------------------------------------- linked runs


def pair_positions(starts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of positions in the same run, in bounded blocks: pairs at
    distance 1 in all runs, then at distance 2, and so on."""
    sizes = np.diff(starts)
    end = np.repeat(starts[1:], sizes)
    at = np.arange(len(end))
    step = 1
    while len(at := at[at + step < end[at]]):
        for lo in range(0, len(at), most):
            i = at[lo : lo + most]
            yield i, i + step
        step += 1


#: Runs of up to so many rows are compared pair by pair, all runs at once.
SHORT_RUN = 32


def spanning_pairs(
    starts: np.ndarray, near: Callable[[np.ndarray | int, np.ndarray], np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of positions that span the components of each run. near(i, j) says which
    of the positions i (or the one position i) link with the positions j.

    In a long run each row that joins a component is compared with the rows that no component
    has yet. So a group whose rows mostly link with one another takes a pass or two, and only
    rows that link with little are compared with all."""
    sizes = np.diff(starts)
    short = sizes <= SHORT_RUN
    at = np.flatnonzero(np.repeat(short, sizes))
    for i, j in pair_positions(np.concatenate([[0], np.cumsum(sizes[short])]), 1 << 18):
        ok = near(at[i], at[j])
        yield at[i][ok], at[j][ok]
    for run in np.flatnonzero(~short):
        free = np.arange(starts[run], starts[run + 1])
        while len(free):
            todo, free = [int(free[0])], free[1:]
            while todo and len(free):
                row = todo.pop()
                ok = near(row, free)
                found = free[ok]
                if len(found):
                    yield np.full(len(found), row), found
                    todo += found.tolist()
                    free = free[~ok]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        if np.array_equal(before, root):
            break
    return root


def merged_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the further edges (a, b)."""
    step = _roots(len(root), root[a], root[b])
    return step[root]


def _runs(batches: Iterator[pa.RecordBatch], cut: int) -> Iterator[tuple[pa.Table, bool]]:
    """Whole runs of equal `key` (rows come sorted by it). A run that outgrows `cut`
    rows leaves in pieces marked True."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        key = held["key"].combine_chunks().to_numpy(zero_copy_only=False)
        start = int(np.searchsorted(key, key[-1], "left")) if (key[1:] >= key[:-1]).all() else 0
        if start:
            yield held.slice(0, start), False
            held = held.slice(start)
        while held.num_rows > cut:
            yield held.slice(0, cut), True
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held, False


def linked_runs(
    rows: DataFrame,
    link: Callable[[dict[str, np.ndarray], np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]],
    finer: tuple[Callable[[DataFrame], DataFrame], Callable] | None = None,
) -> DataFrame:
    """Edges (a, b) between rows with an equal `key` that `link` accepts.

    rows: `key` long, `node` long, and payload columns. `link(columns, starts)` gets the
    columns of several runs (starts: where each begins, and the end) and yields the accepted
    pairs of row positions. Of each run only spanning edges leave the task, one
    at most per row, which keeps connectivity and never emits all pairs of a group.

    Runs of up to RUN_CHUNK rows are compared where they lie. The rows of longer runs go through `finer`, if it is
    given: a function that deals them under finer keys, such that rows that could link meet again, and the link
    function of those. Otherwise, and where finer runs are too long as well, runs are cut into
    chunks, and each pair of chunks is compared in a task of its own, so that no task
    holds more than two chunks of one key.
    """
    spark = rows.sparkSession
    payload = [c for c in rows.columns if c not in ("key", "node")]
    n = partitions(spark)
    dealt = rows.repartition(n, "key").sortWithinPartitions("key")
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def columns(t: pa.Table) -> dict[str, np.ndarray]:
        out = {}
        for c in t.column_names:
            whole = t[c].combine_chunks()
            if pa.types.is_binary(whole.type) or pa.types.is_large_binary(whole.type):
                length = pc.min_max(pc.binary_length(whole)).as_py()
                width = length["max"] or 0
                if length["min"] == width and pa.types.is_binary(whole.type):
                    first = whole.offset * width
                    out[c] = np.frombuffer(whole.buffers()[2], np.uint8)[first : first + len(whole) * width].reshape(len(whole), width)
                    continue
                # values of several lengths (of different runs) are filled up with zeros
                out[c] = np.frombuffer(b"".join([v.ljust(width, b"\0") for v in whole.to_pylist()]), np.uint8).reshape(len(whole), width)
            else:
                out[c] = whole.to_numpy(zero_copy_only=False)
        return out

    def spanning(cols: dict[str, np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, held, size = len(cols["node"]), [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for pair in link(cols, starts):
            held.append(pair)
            size += len(pair[0])
            if size > 1 << 20:
                root = _roots(n, *(np.concatenate(side) for side in zip(*held, strict=True)))
                a = np.flatnonzero(root != np.arange(n))
                held, size = [(a, root[a])], 0
        a, b = (np.concatenate(side) for side in zip(*held, strict=True))
        root = _roots(n, a, b)
        at = np.flatnonzero(root != np.arange(len(root)))
        return cols["node"][at], cols["node"][root[at]]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_of: dict[int, int] = {}
        schema = pa.schema(
            [("a", pa.int64()), ("b", pa.int64()), ("chunk", pa.int32())]
            + [(c, kinds[c]) for c in ("key", "node", *payload)]
        )
        for t, partial in _runs(batches, RUN_CHUNK):
            key = t["key"].combine_chunks().to_numpy(zero_copy_only=False)
            hot = key[-1] if partial else (key[0] if int(key[0]) in chunk_of else None)
            if hot is not None and key[0] == hot:  # a chunk of a long run waits for the other chunks
                own = int(np.searchsorted(key, hot, "right"))
                no = chunk_of.get(int(hot), 0)
                chunk_of = {int(hot): no + 1}
                part = t.slice(0, own)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(own, pa.int64()), pa.nulls(own, pa.int64()), pa.array(np.full(own, no, np.int32))]
                    + [part[c].combine_chunks().cast(kinds[c]) for c in ("key", "node", *payload)],
                    schema=schema,
                )
                t = t.slice(own)
                if not t.num_rows:
                    continue
                key = key[own:]
            cols = columns(t)
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            a, b = spanning(cols, starts)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32())]
                    + [pa.nulls(len(a), kinds[c]) for c in ("key", "node", *payload)],
                    schema=schema,
                )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for t, _ in _runs(batches, 1 << 62):
            key = t["key"].combine_chunks().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                a, b = spanning(columns(t.slice(lo, hi - lo)), np.array([0, hi - lo]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "tinyint": pa.int8(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = {c: arrow[t] for c, t in rows.dtypes}
    found = checkpoint(dealt.mapInArrow(local, f"a long, b long, chunk int, {fields}"))
    edges = found.where("a is not null").select("a", "b")
    long_runs = found.where("chunk is not null")
    if long_runs.isEmpty():
        return edges.distinct()
    if finer:
        deal, finer_link = finer
        return edges.unionByName(linked_runs(deal(long_runs.select("key", "node", *payload)), finer_link)).distinct()
    chunks = long_runs.groupBy("key").agg((F.max("chunk") + 1).alias("chunks"))
    spread = (
        long_runs.drop("a", "b")
        .join(chunks, "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"),
            "node",
            *payload,
        )
    )
    dealt_pairs = spread.repartition(n, "key").sortWithinPartitions("key")
    return edges.unionByName(dealt_pairs.mapInArrow(pairs, "a long, b long")).distinct()


# ------------------------------------------------------- connected components


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node
    reachable. Alternating large and small stars; each round is joins and aggregates, its
    result is checkpointed, and only two sums per round reach the driver."""
    e = checkpoint(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen, total = None, e.count()
    for _ in range(rounds):
        # a node with a third of all edges is dealt over all tasks
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        joined = hot_join(both, low, ["u"], ["v"], total=2 * total)
        large = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            hot_join(large, low2, ["u"], ["v"], total=total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select("u", "m"))
        ).distinct()
        e = checkpoint(small)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen, total = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
