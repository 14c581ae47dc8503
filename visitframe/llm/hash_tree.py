"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through region and rack to a shard. At each level every child
draws -ln(u) / weight, u being a hash of (key, child) in (0, 1), and the smallest draw wins:
a child gets a share in proportion to its weight, and a change of one child's weight moves
rows only into it or out of it. Movement is therefore confined to the subtrees whose weights
change. A shard that joins the tree opens a region of its own, so it takes rows only into
itself and no others move among old shards.

All of it is column expressions over the key; nothing but the key and the tree decides.
Slots within a shard come from two-level prefix sums, so no shard is gathered in one task.

Defined cases: a null text has 0 bytes and checksum 0; null ids draw like any value; rows with
equal ids share the shard and get different slots; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.llm.common import running_total, size_buckets


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """Shards 0..n-1 of equal weight, filled rack by rack and region by region."""
    return [Shard(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(shards)]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region and rack of its own."""
    return [
        *tree,
        Shard(max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1, max(s.shard for s in tree) + 1, weight),
    ]


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 11)
    return -F.log((bits + F.lit(0.5)) * F.lit(2.0**-53)) / F.lit(weight)


def _pick(key: Column, level: str, children: dict[int, float]) -> Column:
    live = {n: w for n, w in children.items() if w > 0}
    if len(live) == 1:
        return F.lit(next(iter(live)))
    draws = [F.struct(_draw(key, level, n, w).alias("draw"), F.lit(n).alias("node")) for n, w in sorted(live.items())]
    return F.array_min(F.array(*draws))["node"]


def _choose(key: Column, level: str, parent: Column, children: dict[int, dict[int, float]]) -> Column:
    live = {p: c for p, c in children.items() if any(w > 0 for w in c.values())}
    out = None
    for p, c in sorted(live.items()):
        one = _pick(key, level, c)
        out = F.when(parent == p, one) if out is None else out.when(parent == p, one)
    return out


def place(df: DataFrame, key: str, tree: list[Shard], out: str = "shard") -> DataFrame:
    """df with `out`_region, `out`_rack and `out` (ints): where each row's key lands."""
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[int, dict[int, float]] = {}
    for s in tree:
        regions[s.region] = regions.get(s.region, 0) + s.weight
        racks.setdefault(s.region, {}).setdefault(s.rack, 0)
        racks[s.region][s.rack] += s.weight
        shards.setdefault(s.rack, {})[s.shard] = s.weight
    k = F.col(key)
    return (
        df.withColumn(f"{out}_region", _pick(k, "region", regions))
        .withColumn(f"{out}_rack", _choose(k, "rack", F.col(f"{out}_region"), racks))
        .withColumn(out, _choose(k, "shard", F.col(f"{out}_rack"), shards))
    )


def with_slots(df: DataFrame, key: str, rows: int, out: str = "slot", others: tuple[str, ...] = ()) -> DataFrame:
    """df with the gapless position of each row in its shard, from 0, in hash order. `others` are further columns
    that spread rows with an equal or null key; rows equal in all of them share a bucket."""
    h = F.xxhash64(F.col(key), *[F.col(c) for c in others], F.lit("slot"))
    hashed = df.withColumn("__h", h).withColumn("__one", F.lit(1).cast("long"))
    bucketed = hashed.withColumn("__bucket", F.pmod("__h", F.lit(size_buckets(rows // 16, least=8))))
    return (
        running_total(bucketed, ["shard"], "__bucket", [F.col("__h"), F.col(key)], "__one", out)
        .withColumn(out, F.col(out) - 1)
        .drop("__h", "__one", "__bucket")
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", tree: list[Shard] | None = None) -> None:
    """docs as Parquet under region=/rack=/shard= folders."""
    placed = place(docs.drop("region", "rack", "shard"), key, tree or even_tree(16), "shard")
    placed.withColumnsRenamed({"shard_region": "region", "shard_rack": "rack"}).write.partitionBy(
        "region", "rack", "shard"
    ).parquet(path)


def op6_hash_tree(docs: DataFrame, shards: int = 16) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    light = docs.select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    tree = even_tree(shards)
    placed = place(place(light, "doc_id", tree), "doc_id", grow(tree), "grown_shard")
    return with_slots(placed, "doc_id", docs.select("doc_id").count(), others=("text_crc32", "size")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int"),
        F.col("slot").cast("long"),
        F.col("grown_shard").cast("int"),
    )
