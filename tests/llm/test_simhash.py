"""SimHash against all pairs."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from visitframe.llm import common, simhash

SCHEMA = "doc_id long, text string"


def fingerprint(text: str | None, words: int) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    own = [" ".join(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows: list[tuple[int, str | None]], words: int = 4, distance: int = 4) -> dict[int, tuple[str, int]]:
    ids, fps = [r[0] for r in rows], np.array([fingerprint(r[1], words) for r in rows], np.uint64)
    low = {i: i for i in ids}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= distance):
            x, y = sorted((top(ids[a]), top(ids[a + 1 + int(b)])))
            low[y] = x
    return {i: (f"{int(f):016x}", top(i)) for i, f in zip(ids, fps, strict=True)}


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    near = [(10_000_000 + k, " ".join(base * 30 + base[: k % 7])) for k in range(40)]
    odd = [(20_000_000, None), (20_000_001, ""), (20_000_002, " \n"), (20_000_003, "One"), (20_000_004, "ONE"), (20_000_005, "long word " * 70_000)]
    both = docs.union(spark.createDataFrame(near + odd, SCHEMA))
    rows = [(r[0], r[1]) for r in both.collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op4_simhash(both).collect()}
    assert got == brute(rows)
    assert got[20_000_000] == ("0" * 16, got[20_000_001][1]) and got[20_000_003] == got[20_000_004]


def test_every_distance_up_to_five_bits_is_found(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    other = base.copy()
    for i in range(60):
        for bit in rng.choice(64, i % 6, replace=False):
            other[i] ^= np.int64(np.uint64(1 << int(bit)).view(np.int64))
    fps = sorted({int(x) for x in (*base, *other)})
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = common.connected_components(common.linked_runs(simhash.signatures(rows), simhash._linker(5)))
    group = {r["node"]: r["component"] for r in edges.collect()}
    assert all(group[int(a)] == group[int(b)] for a, b in zip(base, other, strict=True) if a != b)


def test_long_runs_lose_no_link(spark):
    n = 3 * common.RUN_CHUNK + 17
    rows = spark.range(n).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node"), F.col("id").alias("at"))

    def link(cols, starts):
        order = np.argsort(cols["at"])
        near = np.flatnonzero(np.diff(cols["at"][order]) == 1)
        yield order[near], order[near + 1]

    edges = common.linked_runs(rows, link)
    parts = common.connected_components(edges)
    # consecutive nodes fall in different chunks somewhere, so only pairs of chunks can link them
    assert parts.count() == n and parts.where("component != 0").count() == 0


def test_long_runs_are_spanned_without_all_pairs():
    rng = np.random.default_rng(3)
    group = rng.integers(0, 40, 3000)
    compared = 0

    def near(i, j):
        nonlocal compared
        compared += len(j)
        return group[i] == group[j]

    edges = [e for e in common.spanning_pairs(np.array([0, 3000]), near)]
    root = common._roots(3000, np.concatenate([a for a, _ in edges]), np.concatenate([b for _, b in edges]))
    assert all(len(set(root[group == g])) == 1 for g in range(40)) and len(set(root)) == 40
    assert sum(len(a) for a, _ in edges) == 3000 - 40
    one = common.spanning_pairs(np.array([0, 100_000]), lambda i, j: np.ones(len(j), bool))
    assert sum(len(a) for a, _ in one) == 99_999


def test_empty_table(spark):
    assert simhash.op4_simhash(spark.createDataFrame([], SCHEMA)).count() == 0
