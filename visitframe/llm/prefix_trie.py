"""Trie of conversation prefixes: succinct level-order tries of prefix shards, heavy upper levels merged apart.

Every distinct sequence of first turns is a node, known by 128 bits: the exclusive or of the hashes of its turns, each
taken with its place. Such prefixes add up in any order, so a conversation of any length is worked on in pieces.

A node's weight is the number of turns at and below it, copies counted. Nodes over SHARD_ROWS are heavy; each
light node below a heavy one is the root of a prefix shard, which therefore fits one task. There numpy orders the nodes level by
level, writes the trie as LOUDS (one bit per child and a zero, node by node) with an array of labels, reads the parents
from the bits by counting zeros, and sums leaves and savings from the last level up with add.at.

Heavy nodes are few but where conversations are very long, so they are merged by Spark: grouped by prefix, counts of
members combined before they move, and summed along chains. A chain is the stretch of heavy nodes whose owner, the
member with the smallest hash, is the same; what hangs on a chain reaches the chain above in a round, of which there are
logarithmically many in the conversations, as owners are drawn at random. Inside a chain the sums are prefix sums of two levels.

Defined cases: turns are ordered by turn (null first), then role, then text; null role and text are empty; rows without
conversation id belong to no conversation; repeated rows are turns of their own; columns beyond the four don't come through;
an empty table gives no node. The sha256 of a node's ended members is one sequence by its nature: one task reads the
node's sorted ids as a stream, without holding them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.llm.common import checkpoint, hot_join, partitions, running_total, written

#: Turns of a prefix shard at most.
SHARD_ROWS = 1 << 10
#: Turns of one conversation that are prefix-summed in one window.
STRETCH = 1 << 12
#: Rows of shards that a task works on at once.
AT_ONCE = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# ------------------------------------------------------------------- turns


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, n_bytes): the turns by their place from 1, with two hashes of role and text. The whole table is sorted by
    range, and places are counted inside each range from where the conversation's last one ended."""
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = turns.repartitionByRange(partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
    hashed = ranged.select(
        "conv_id",
        F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit(1), "role", "text").alias("b"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.spark_partition_id().alias("part"),
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            at = np.arange(len(c)) - np.repeat(starts, np.diff(np.append(starts, len(c)))) + 1
            if last == c[0]:
                at[: starts[1] if len(starts) > 1 else len(c)] += count
            last, count = c[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["conv_id", "a", "b", "n_bytes", "part", "at"])

    placed = written(hashed.mapInArrow(number, "conv_id long, a long, b long, n_bytes long, part int, at long"))
    sums = placed.groupBy("conv_id", "part").agg(F.max("at").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only the first conversation of a range can have begun before it, so these rows are no more than the ranges
    offsets = sums.withColumn("before", F.sum("n").over(before)).where("before > 0").select("conv_id", "part", "before")
    whole = placed.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return whole.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "a", "b", "n_bytes")


def rebuilt(turns: DataFrame, head_turns: Column, most: int, base: Column) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation's first `head_turns` turns (an expression of conv_id, `most` at the most) were
    replaced by those of conversation `base`. turns: (conv_id, d, a, b, n_bytes, size); conversations: (conv_id, size)."""
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    own = counts.withColumn("h", head_turns).withColumn("base", base).join(bases, "base", "left")
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    known = checkpoint(
        own.select("conv_id", "n", "h", "base", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    )
    tails = hot_join(turns, known.drop("base"), ["conv_id"], ["pos"]).where("pos > h")
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base").join(known.where("head > 0"), "base").where("pos <= head")
    columns = ["a", "b", "n_bytes", "size"]
    both = tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("d"), *columns).unionByName(
        heads.select("conv_id", F.col("pos").alias("d"), *columns)
    )
    return both, known.select("conv_id", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """turns with x, y, the hashes of the turn in its place, and px, py, the prefix that ends with it."""
    placed = turns.select(
        "conv_id",
        "d",
        "n_bytes",
        "size",
        F.xxhash64("d", "a", "b").alias("x"),
        F.xxhash64("b", "d", "a").alias("y"),
        F.floor((F.col("d") - 1) / STRETCH).cast("long").alias("stretch"),
    )
    sums = placed.where(F.col("size") > STRETCH).groupBy("conv_id", "stretch").agg(F.bit_xor("x").alias("sx"), F.bit_xor("y").alias("sy"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv_id", "stretch", F.bit_xor("sx").over(before).alias("ox"), F.bit_xor("sy").over(before).alias("oy"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.withColumn("ix", F.bit_xor("x").over(inside)).withColumn("iy", F.bit_xor("y").over(inside))
    found = within.join(offsets, ["conv_id", "stretch"], "left")
    return found.select(
        "conv_id",
        "d",
        "n_bytes",
        "size",
        "x",
        "y",
        F.col("ix").bitwiseXOR(F.coalesce("ox", F.lit(0))).alias("px"),
        F.col("iy").bitwiseXOR(F.coalesce("oy", F.lit(0))).alias("py"),
    )


# ------------------------------------------------------------------ shards


@dataclass
class Louds:
    """A forest in level order: for the super-root and each node as many ones as it has children, then a zero."""

    bits: np.ndarray
    labels: np.ndarray  # two columns, node by node
    levels: np.ndarray  # where each level begins, and the end

    def parents(self) -> np.ndarray:
        """Parent of each node, -1 for roots: node k is the k-th one, and the zeros before it tell its parent."""
        zeros = np.cumsum(~self.bits)
        return zeros[self.bits] - 1

    def degrees(self) -> np.ndarray:
        ends = np.flatnonzero(~self.bits)
        return np.diff(ends) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums of values over subtrees, from the last level to the first."""
        out, parents = values.copy(), self.parents()
        for lo, hi in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            np.add.at(out, parents[lo:hi], out[lo:hi])
        return out


def level_order(level: np.ndarray, parent: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, Louds]:
    """(order, trie) of nodes with their level from 0, parent (any for level 0) and labels; children are ordered by label."""
    n = len(level)
    by_level = np.argsort(level, kind="stable")
    levels = np.concatenate([[0], np.cumsum(np.bincount(level))]) if n else np.zeros(1, np.int64)
    place = np.empty(n, np.int64)
    order = np.empty(n, np.int64)
    degree = np.zeros(n + 1, np.int64)  # the super-root's first
    for k, (lo, hi) in enumerate(zip(levels[:-1], levels[1:], strict=True)):
        own = by_level[lo:hi]
        above = place[parent[own]] + 1 if k else np.zeros(hi - lo, np.int64)
        row = np.lexsort((labels[own, 1], labels[own, 0], above))
        order[lo:hi] = own[row]
        place[own[row]] = np.arange(lo, hi)
        np.add.at(degree, above, 1)
    bits = np.ones(n + len(degree), bool)
    bits[np.cumsum(degree + 1) - 1] = False
    return order, Louds(bits, labels[order], levels)


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, first row of each number) of rows that are equal in all columns."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def joined_digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def shard_nodes(t: dict[str, np.ndarray]) -> dict[str, np.ndarray | list]:
    """The nodes of whole shards. t has conv_id, d, n_bytes, size, x, y, px, py and `top`, the depth of the shard's root."""
    m = len(t["d"])
    both_x, both_y = np.concatenate([t["px"], t["px"] ^ t["x"]]), np.concatenate([t["py"], t["py"] ^ t["y"]])
    number, _ = _numbered(both_x, both_y)
    ids, inverse = np.unique(number[:m], return_inverse=True)  # nodes among all prefixes and their parents
    first = np.zeros(len(ids), np.int64)
    first[inverse[::-1]] = np.arange(m)[::-1]
    parent = np.searchsorted(ids, number[m:][first])
    labels = np.stack([t["x"][first], t["y"][first]], axis=1)
    order, trie = level_order((t["d"] - t["top"])[first], np.minimum(parent, len(ids) - 1), labels)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at, first = place[inverse], first[order]
    convs = np.bincount(at, minlength=len(order))
    smallest = np.full(len(order), np.iinfo(np.int64).max)
    np.minimum.at(smallest, at, t["conv_id"])
    degrees, parents = trie.degrees(), trie.parents()
    ends = [NO_ENDS] * len(order)
    done = np.flatnonzero(t["d"] == t["size"])
    done = done[np.lexsort((t["conv_id"][done], at[done]))]
    cut = np.flatnonzero(at[done][1:] != at[done][:-1]) + 1
    for own in np.split(done, cut) if len(done) else []:
        ends[at[own[0]]] = joined_digest(t["conv_id"][own])
    above = np.where(parents < 0, 0, smallest[parents])
    return {
        "conv_id": smallest,
        "depth": t["d"][first],
        "parent_conv_id": np.ma.array(above, mask=parents < 0),
        "n_convs": convs,
        "n_children": degrees,
        "n_leaves": trie.rolled_up((degrees == 0).astype(np.int64)),
        "saved_tokens": trie.rolled_up((convs - 1) * t["n_bytes"][first]),
        "ends_sha256": ends,
        "qx": (t["px"] ^ t["x"])[first],
        "qy": (t["py"] ^ t["y"])[first],
    }


def light_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of all shards; rows carry `sx`, `sy`, the prefix of the shard's root, and `top`. parent_conv_id is null for the roots."""
    names = ["conv_id", "d", "n_bytes", "size", "x", "y", "px", "py", "top", "sx", "sy"]
    dealt = rows.select(*names).repartition(partitions(rows.sparkSession), "sx", "sy").sortWithinPartitions("sx", "sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def nodes(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if t.num_rows:
                found = shard_nodes({c: t[c].to_numpy() for c in names})
                arrays = [pa.array(v.data, mask=np.ma.getmaskarray(v)) if isinstance(v, np.ma.MaskedArray) else pa.array(v) for v in found.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=list(found))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= AT_ONCE:
                t = pa.Table.from_batches(held)
                sx, sy = t["sx"].to_numpy(), t["sy"].to_numpy()
                same = (sx == sx[-1]) & (sy == sy[-1])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                yield from nodes(t.slice(0, cut))
                held, size = t.slice(cut).to_batches(), t.num_rows - cut
        if held:
            yield from nodes(pa.Table.from_batches(held))

    longs = ", ".join(f"{c} long" for c in OUT[:-1])
    return dealt.mapInArrow(run, f"{longs}, ends_sha256 string, qx long, qy long")


# ------------------------------------------------------------ upper levels


def ended(rows: DataFrame) -> DataFrame:
    """(px, py, ends_sha256) over (px, py, conv_id): ids in ascending order go through the digest as a stream."""
    dealt = rows.repartition(partitions(rows.sparkSession), "px", "py").sortWithinPartitions("px", "py", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            px, py, c = (batch.column(k).to_numpy() for k in range(3))
            starts = np.flatnonzero(np.concatenate([[True], (px[1:] != px[:-1]) | (py[1:] != py[:-1])]))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(c)], strict=True):
                part = ",".join(map(str, c[lo:hi].tolist())).encode()
                if key == (px[lo], py[lo]):
                    digest.update(b"," + part)
                    continue
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (px[lo], py[lo]), hashlib.sha256(part)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, digest.hexdigest()), kinds, strict=True)], names=names)

    kinds, names = [pa.int64(), pa.int64(), pa.string()], ["px", "py", "ends_sha256"]
    return dealt.mapInArrow(run, "px long, py long, ends_sha256 string")


def heavy_nodes(rows: DataFrame, convs: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots): the heavy nodes, of all turns `rows` at heavy prefixes and the conversations, whose root is always heavy; and the
    roots of the shards with their parent's conv_id."""
    members = [
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.min(F.struct(F.xxhash64("conv_id").alias("draw"), F.col("conv_id").alias("id"))).alias("owner"),
    ]
    zero = F.lit(0).cast("long")
    # prefixes and what lies above them are the same for all rows of a group
    above = [F.first(F.col("px").bitwiseXOR(F.col("x"))).alias("qx"), F.first(F.col("py").bitwiseXOR(F.col("y"))).alias("qy")]
    inner = rows.groupBy("px", "py").agg(F.first("d").alias("depth"), F.first("n_bytes").alias("n_bytes"), *above, *members)
    top = convs.groupBy(zero.alias("px"), zero.alias("py")).agg(*members)
    none = F.lit(None).cast("long")
    top = top.withColumns({"depth": zero, "n_bytes": zero, "qx": none, "qy": none})
    nodes = checkpoint(inner.unionByName(top))
    below = roots.groupBy("qx", "qy").agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    inside = nodes.where("depth > 0").groupBy("qx", "qy").agg(F.count("*").alias("n"))
    counted = (
        nodes.join(below.select(F.col("qx").alias("px"), F.col("qy").alias("py"), F.col("n").alias("n_roots"), "leaves", "saved"), ["px", "py"], "left")
        .join(inside.select(F.col("qx").alias("px"), F.col("qy").alias("py"), F.col("n").alias("n_heavy")), ["px", "py"], "left")
        .fillna(0, ["n_roots", "n_heavy", "leaves", "saved"])
        .withColumn("n_children", F.col("n_roots") + F.col("n_heavy"))
    )
    finished = rows.where("d = size").select("px", "py", "conv_id").unionByName(
        convs.where("size = 0").select(zero.alias("px"), zero.alias("py"), "conv_id")
    )
    counted = checkpoint(counted.join(ended(finished), ["px", "py"], "left").fillna(NO_ENDS, ["ends_sha256"]))

    def named(count: str) -> DataFrame:
        return counted.where(F.col(count) > 0).select(
            F.col("px").alias("qx"),
            F.col("py").alias("qy"),
            F.col("conv_id").alias("parent_conv_id"),
            F.col("owner.id").alias("above"),
            F.col("depth").alias("joint"),
            F.col(count).alias("n"),
        )

    roots = hot_join(roots.drop("parent_conv_id"), named("n_roots"), ["qx", "qy"], ["conv_id"])
    children = hot_join(counted.where("depth > 0"), named("n_heavy"), ["qx", "qy"], ["px"])
    whole = children.drop("n").unionByName(counted.where("depth = 0"), allowMissingColumns=True)
    whole = checkpoint(whole.withColumn("owner", F.col("owner.id")))
    own = whole.select(
        "owner",
        "depth",
        (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    )
    chains = checkpoint(whole.where("above is not null and above != owner").select("owner", "above", "joint"))
    parts, moving = own, own
    while True:
        sums = moving.groupBy("owner").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        moving = checkpoint(sums.join(chains, "owner").select(F.col("above").alias("owner"), F.col("joint").alias("depth"), "leaves", "saved"))
        if moving.isEmpty():
            break
        parts = parts.unionByName(moving)
    sums = parts.groupBy("owner", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sums = sums.withColumn("stretch", -F.floor(F.col("depth") / STRETCH))
    down = [F.col("depth").desc()]
    for value, out in (("leaves", "n_leaves"), ("saved", "saved_tokens")):
        sums = running_total(sums, ["owner"], "stretch", down, value, out)
    found = whole.join(sums.select("owner", "depth", "n_leaves", "saved_tokens"), ["owner", "depth"])
    return found.select(*OUT), roots.select(*OUT)


def trie_nodes(turns: DataFrame, convs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie of conversations `convs` (conv_id, size) with `turns` (conv_id, d from 1, a, b, n_bytes, size)."""
    rows = written(prefixes(turns))
    weights = written(
        rows.groupBy("px", "py").agg(
            F.sum(F.col("size") - F.col("d") + 1).alias("weight"),
            F.first("d").alias("top"),
            F.first(F.col("px").bitwiseXOR(F.col("x"))).alias("qx"),
            F.first(F.col("py").bitwiseXOR(F.col("y"))).alias("qy"),
        )
    )
    heavy = weights.where(F.col("weight") > shard_rows)
    light = weights.where(F.col("weight") <= shard_rows)
    children = light.where("top > 1").groupBy("qx", "qy").agg(F.count("*").alias("n"))
    parents = heavy.select(F.col("px").alias("qx"), F.col("py").alias("qy")).join(children, ["qx", "qy"])
    inner = hot_join(light.where("top > 1"), parents, ["qx", "qy"], ["px"])
    shards = light.where("top = 1").select("px", "py", "top").unionByName(inner.select("px", "py", "top"))
    member = rows.select("conv_id", "px", "py").join(shards, ["px", "py"]).select("conv_id", F.col("px").alias("sx"), F.col("py").alias("sy"), "top")
    anchored = convs.join(member, "conv_id", "left").select("conv_id", F.col("size").alias("n"), "sx", "sy", "top")
    placed = written(hot_join(rows, checkpoint(anchored), ["conv_id"], ["d"]).drop("n"))
    nodes = written(light_nodes(placed.where("d >= top")))
    upper, roots = heavy_nodes(placed.where("top is null or d < top"), convs, nodes.where("parent_conv_id is null"))
    return nodes.where("parent_conv_id is not null").select(*OUT).unionByName(roots).unionByName(upper)


def op12_prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("long")
    turns, convs = rebuilt(numbered_turns(conversations), h, 8, F.col("conv_id") - F.col("conv_id") % 5)
    return trie_nodes(turns, convs, shard_rows)


#: The crc32 of a decimal, bit by bit: each byte goes in with its first bit.
_CRC = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda crc, b: xor(xor(crc, b) >> 1, 3988292384 * (xor(crc, b) & 1))))"""

ORACLE = f"""
WITH t AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY pos) AS turns FROM t GROUP BY conv_id),
c AS (SELECT conv_id, turns, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM own),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM c LEFT JOIN own b ON b.conv_id = c.base),
p AS (SELECT conv_id, d, turns[1:d] AS path, d = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE strlen(path[d].text) END AS n_bytes
  FROM p GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (path, d)),
s AS (
  SELECT u.path, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.n_bytes) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS e FROM a) v JOIN a u ON u.d = v.e AND u.path = v.path[1:v.e] GROUP BY u.path)
SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM a JOIN s USING (path) LEFT JOIN n b ON a.d > 0 AND b.d = a.d - 1 AND b.path = a.path[1:a.d - 1]
"""
