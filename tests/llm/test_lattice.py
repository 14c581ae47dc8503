"""E8 hashing: decoder against search, results against all pairs."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from visitframe.llm import e8_neighbors as e8


def test_decoder_finds_the_nearest_point():
    y = np.random.default_rng(2).normal(scale=1.3, size=(300, 8))
    near = e8.lattice_cells(y, 0)[:, 0] / 2
    assert ((near % 1 == 0).all(axis=1) | (near % 1 == 0.5).all(axis=1)).all() and (near.sum(axis=1) % 2 == 0).all()
    # no minimal vector of the lattice leads to a nearer point
    steps = [v for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1) for v in [np.bincount([i, j], [a, b], 8)]]
    steps += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    assert len(steps) == 240
    own = ((y - near) ** 2).sum(axis=1)
    assert all((((y - near - v) ** 2).sum(axis=1) >= own - 1e-12).all() for v in steps)


def brute(rows):
    ids, links = [r[0] for r in rows], {}
    unit = {}
    for i, (_, label, v) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    for i, j in itertools.combinations(sorted(unit), 2):
        if rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= e8.THRESHOLD:
            links.setdefault(i, set()).add(j)
            links.setdefault(j, set()).add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links.get(todo.pop(), set()) - seen)
            seen |= new
        out.append((ids[i], len(links.get(i, ())), min(ids[k] for k in seen)))
    return sorted(out)


def test_against_all_pairs_with_defined_cases(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(60):
        base = rng.normal(size=16)
        for k in range(4):
            v = base + rng.normal(size=16) * 0.08
            rows.append((len(rows), c % 3, v.astype(np.float32).tolist()))
    same = [1.0] * 16
    n = len(rows)
    rows += [(n + k, 0, same) for k in range(30)] + [(n + 30, 1, same), (n + 31, None, same), (n + 32, 0, None), (n + 33, 0, [0.0] * 16)]
    rows += [(n + 34, 0, [float("nan")] + same[1:]), (n + 35, 0, [None] + same[1:]), (n + 36, 0, [float("inf")] + same[1:]), (n + 37, 0, same[:8]), (n + 38, 0, []), (n + 39, 0, [1e30] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("n_links", F.lit("clash"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in e8.op10_e8_neighbors(df).collect())
    want = brute(rows)
    # hashing may miss a link near the threshold, no more than one in a hundred here
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= len(rows) // 100
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))


def test_repeated_ids_and_empty_table(spark):
    rows = [(5, 1, [1.0, 0.0]), (5, 1, [0.0, 1.0]), (6, 1, [0.0, 1.0]), (None, 1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in e8.op10_e8_neighbors(df).collect())
    assert got == [(0, 0, 0), (5, 0, 5), (5, 1, 5), (6, 1, 5)]
    assert e8.op10_e8_neighbors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    u = e8.unit(rng.normal(size=(3000, 64)))
    w = rng.normal(size=u.shape)
    w = e8.unit(w - (w * u).sum(axis=1, keepdims=True) * u)
    v = e8.THRESHOLD * u + np.sqrt(1 - e8.THRESHOLD**2) * w
    step = np.sqrt(2 - 2 * e8.THRESHOLD) / e8.REACH
    met = np.zeros(len(u), bool)
    for m in e8.projections(64, e8.TABLES, 8) * (np.sqrt(8) / step):
        a, b = e8.lattice_cells(u @ m, e8.PROBES), e8.lattice_cells(v @ m, e8.PROBES)
        met |= (a[:, :, None] == b[:, None]).all(axis=3).any(axis=(1, 2))
    assert met.mean() > 0.99


def test_blocks_of_a_large_component(spark):
    n = 2 * e8.TILE + 100
    rng = np.random.default_rng(11)
    rows = [(k, 1, (np.eye(16)[0] + 0.02 * rng.normal(size=16)).tolist()) for k in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert e8.op10_e8_neighbors(df).where(f"n_links != {n - 1} or component_id != 0").isEmpty()


def test_members_are_copied_to_few_blocks(spark):
    """Ten million members of 64 numbers, dealt to 1,000 tasks: each is copied 306 times (once per 1,024 members it
    were 9,766 times), and no block holds more than its share."""
    sizes = spark.createDataFrame([(10,), (5000,), (100_000,), (10_000_000,)], "n long")
    got = {r["n"]: r["b"] for r in sizes.select("n", e8.block_count(F.col("n"), F.lit(64), 1000).alias("b")).collect()}
    assert got == {10: 1, 5000: 5, 100_000: 90, 10_000_000: 306}
    assert all(n * 64 / b <= max(e8.BLOCK_NUMBERS, 64 * e8.TILE) * 1.01 for n, b in got.items())


def test_links_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(e8, "TILE", 8)
    rng = np.random.default_rng(11)
    base = rng.normal(size=16)
    rows = [(k, 1, (base + 0.1 * rng.normal(size=16)).tolist()) for k in range(150)]
    got = e8.op10_e8_neighbors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == brute(rows)
