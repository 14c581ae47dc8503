"""Mixing and sharding: SQL, laws and defined cases."""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from visitframe.llm import hash_tree, mixing
from visitframe.llm.registry import op6_hash_tree

SMALL = "/root/testdata/sf0.01"


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = mixing.op5_mixing(docs)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    per = got.groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.max("size").alias("most")).collect()
    assert abs(sum(r["taken"] for r in per) - sum(r["size"] for r in per)) <= max(r["most"] for r in per)
    for r in per:
        assert r["size"] == r["source_size"] and r["target"] <= 3 * r["size"] + 1e-6
        assert abs(r["taken"] - r["target"]) <= r["most"] + 1
    assert got.where("taken > 3 * size or size > 0 and taken % size != 0").isEmpty()
    assert got.exceptAll(mixing.op5_mixing(docs.repartition(5))).isEmpty()


def test_mixing_defined_cases(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (None, "d e", "x"), (3, "f g", "x"), (3, "f g", "x"), (3, "f g h", "x"), (4, " ", "y")] + [(k, "w " * 5, "z") for k in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs)
    assert got.count() == len(rows) and got.where("size = 0 and taken > 0").isEmpty()
    repeated = Counter((r["doc_id"], r["text"]) for r in mixing.repeat_documents(docs).collect())
    # what is repeated is what was taken, rows with equal ids included
    assert sum(len(t.split()) * n for (_, t), n in repeated.items()) == got.agg(F.sum("taken")).first()[0]
    assert mixing.repeat_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == mixing.repeat_documents(docs.limit(0)).count() == 0
    nothing = docs.where("size = 'clash' and text is null")
    assert mixing.mix(nothing).first()["taken"] == 0


def test_shards_hold_the_key_law(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = hash_tree.op6_hash_tree(docs).collect()
    assert all(r["grown_shard"] in (r["shard"], 16) and r["law"] == "key" for r in rows)
    slots: dict[int, list[int]] = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r["doc_id"]: r["shard"] for r in hash_tree.op6_hash_tree(docs.where("doc_id % 3 = 0")).collect()}
    assert all(again.get(r["doc_id"], r["shard"]) == r["shard"] for r in rows)


def test_movement_is_confined_to_the_changed_subtree(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    tree = hash_tree.even_tree(16)
    heavy = [hash_tree.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in tree]
    both = hash_tree.place(hash_tree.place(keys, "k", tree), "k", heavy, "now")
    moved = [(r["shard"], r["now"]) for r in both.where("shard != now").collect()]
    # rows move towards shard 5, or within its region and rack on the way there; none leaves it
    assert moved and all(a != 5 for a, _ in moved)
    assert all(b == 5 or (b // 4 == 1 and a // 4 != 1) or (b // 8 == 0 and a // 8 == 1) for a, b in moved)
    share = both.where("now = 5").count() / 20_000
    assert abs(share - 3 / 18) < 0.02
    empty = [hash_tree.Shard(s.region, s.rack, s.shard, 0.0 if s.shard == 2 else 1.0) for s in tree]
    assert hash_tree.place(keys, "k", empty).where("shard = 2 or shard is null").isEmpty()


def test_sharding_defined_cases(spark, tmp_path):
    rows = [(1, None), (1, None), (None, "a"), (None, ""), (2, "é" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("region", F.lit(1))
    got = hash_tree.op6_hash_tree(docs).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 1, 2, 200_001]
    assert len({(r["shard"], r["slot"]) for r in got}) == 5
    assert hash_tree.op6_hash_tree(docs.limit(0)).count() == 0
    hash_tree.write_shards(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def plain_place(key: int, tree: list[hash_tree.Shard]) -> int:
    """The draws in plain Python: one XXH64 per child, chained over key, level and node."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)

    def pick(level: str, children: dict[int, float]) -> int:
        own = xxhash.xxh64_intdigest(level.encode(), h)
        drawn = []
        for node, weight in sorted(children.items()):
            bits = xxhash.xxh64_intdigest(struct.pack("<i", node), own) >> 11
            drawn.append((-math.log((bits + 0.5) * 2.0**-53) / weight, node))
        return min(drawn)[1] if len(drawn) > 1 else drawn[0][1]

    region = pick("region", {s.region: sum(x.weight for x in tree if x.region == s.region) for s in tree})
    rack = pick("rack", {s.rack: sum(x.weight for x in tree if x.rack == s.rack) for s in tree if s.region == region})
    return pick("shard", {s.shard: s.weight for s in tree if s.rack == rack})


def test_query_against_plain_draws(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = {r["doc_id"]: r for r in op6_hash_tree(spark, SMALL).collect()}
    assert set(got) == set(texts)
    tree = hash_tree.even_tree(16)
    order: dict[int, list[tuple[int, int, int]]] = {}
    buckets = max(8, min(16384, len(texts) // 16 // 2000))
    for key, raw in texts.items():
        row = got[key]
        shard, grown = plain_place(key, tree), plain_place(key, hash_tree.grow(tree))
        assert (row["shard"], row["grown_shard"], row["law"]) == (shard, grown, "key")
        assert (row["size"], row["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        h = 42
        for part in (struct.pack("<q", key), struct.pack("<q", zlib.crc32(raw)), struct.pack("<q", len(raw) + 1), b"slot"):
            h = xxhash.xxh64_intdigest(part, h)
        signed = h - (1 << 64) if h >> 63 else h
        order.setdefault(shard, []).append((signed % buckets, signed, key))
    for shard, rows in order.items():
        assert [got[key]["slot"] for _, _, key in sorted(rows)] == list(range(len(rows))), shard


def test_rows_without_id_are_spread(spark):
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"), F.lit("s").alias("source"))
    assert docs.select(mixing.shuffle_hash("doc_id", "mix", F.xxhash64("text"))).distinct().count() == 5000
    taken = mixing.op5_mixing(docs)
    assert taken.count() == 5000 and taken.where("taken != size").isEmpty()
    placed = hash_tree.op6_hash_tree(docs).collect()
    assert len({(r["shard"], r["slot"]) for r in placed}) == 5000
