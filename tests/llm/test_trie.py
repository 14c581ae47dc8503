"""The prefix trie: against plain dictionaries, for every size of shard; LOUDS bits; defined cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitframe.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows: list[tuple]) -> list[tuple]:
    by_conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by_conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in by_conv.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) if children[path] else 1
        size = len(path[-1][1].encode()) if path else 0
        saved[path] = (len(members[path]) - 1) * size + sum(saved[x] for x in children[path])
    return sorted(
        (
            members[p][0],
            len(p),
            members[p[:-1]][0] if p else -1,
            len(members[p]),
            len(children[p]),
            leaves[p],
            saved[p],
            hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest(),
        )
        for p in members
    )


def result(df) -> list[tuple]:
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*pt.OUT).collect())


def conversations(seed: int, convs: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(rng.randrange(14)):
            text = rng.choice(["hello", "", None, "é" * 5, "why?"]) if turn < rng.randrange(10) else f"own {c} {turn}"
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", None, "bot"]) if turn % 3 == 0 else "user", text))
    for c in range(convs, convs + 30):  # copies
        rows += [(c, turn, "user", "copy " * turn) for turn in range(20)]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None)]
    return rows + rows[:40]


@pytest.mark.parametrize(("shard_rows", "stretch", "at_once"), [(1 << 14, 1 << 12, 1 << 16), (40, 3, 60), (3, 2, 1), (0, 5, 10)])
def test_against_dictionaries(spark, monkeypatch, shard_rows, stretch, at_once):
    monkeypatch.setattr(pt, "STRETCH", stretch)
    monkeypatch.setattr(pt, "AT_ONCE", at_once)
    rows = conversations(shard_rows, 70)
    assert result(pt.op12_prefix_trie(spark.createDataFrame(rows, SCHEMA), shard_rows)) == expected(rows)


def test_one_long_conversation_and_nested_ones(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(3000)]
    rows += [(10 * k, t, "user", f"turn {t}") for k in range(2, 40) for t in range(37 * k)]
    assert result(pt.op12_prefix_trie(spark.createDataFrame(rows, SCHEMA), 500)) == expected(rows)


def test_louds_of_a_known_tree():
    #        0
    #      1   2
    #     3   4 5
    level, parent = np.array([0, 1, 1, 2, 2, 2]), np.array([0, 0, 0, 1, 2, 2])
    labels = np.array([[0, 0], [1, 0], [2, 0], [1, 0], [1, 0], [2, 0]])
    mixed = np.array([5, 3, 0, 4, 2, 1])  # any order of rows gives the same trie
    inverse = np.argsort(mixed)
    order, trie = pt.level_order(level[mixed], inverse[parent[mixed]], labels[mixed])
    assert mixed[order].tolist() == [0, 1, 2, 3, 4, 5]
    assert "".join(map(str, trie.bits.astype(int))) == "10" + "110" + "10" + "110" + "000"
    assert trie.parents().tolist() == [-1, 0, 0, 1, 2, 2]
    assert trie.degrees().tolist() == [2, 1, 2, 0, 0, 0]
    assert trie.rolled_up(np.ones(6, int)).tolist() == [6, 2, 3, 1, 1, 1]


def test_defined_cases(spark):
    rows = [(-7, 1, "user", "x"), (-7, 0, None, "y"), (4, None, "user", None), (4, 5, "b", "t"), (4, 5, "a", "t"), (4, 5, "a", "s"), (3, 0, "user", "z" * 2_000_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash"))
    plain = [r for r in rows if r[0] != -7]
    assert result(pt.op12_prefix_trie(df.where("conv_id != -7"))) == expected(plain)
    assert pt.op12_prefix_trie(df).where("depth = 0").first()["conv_id"] == -7
    assert pt.op12_prefix_trie(df.limit(0)).count() == 0
    root = pt.op12_prefix_trie(spark.createDataFrame([(5, 0, "user", "x")], SCHEMA)).collect()
    assert len(root) == 2 and root[0]["saved_tokens"] == 0
