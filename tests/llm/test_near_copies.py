"""Near copies of the pipeline against all pairs."""

from __future__ import annotations

import math

import numpy as np
import xxhash

import corpus_pipeline
from visitframe.llm import common, near_copies

SCHEMA = "doc_id long, text string"
WRAP = (1 << 64) - 1


def shingles(text: str, words: int) -> set[bytes]:
    w = text.lower().encode().split()
    return {b" ".join(w[k : k + words]) for k in range(max(len(w) - words + 1, min(len(w), 1)))}


def plain_print(features: set[bytes], count: int) -> list[int]:
    """The fingerprint bit by bit, in plain integers."""
    ones = [0] * (64 * count)
    for f in features:
        h = xxhash.xxh64_intdigest(f, 42)
        for c in range(count):
            x = h + (c + 1) * 0x9E3779B97F4A7C15 & WRAP
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & WRAP
            x = (x ^ x >> 27) * 0x94D049BB133111EB & WRAP
            x ^= x >> 31
            for byte, value in enumerate(x.to_bytes(8, "little")):
                for bit in range(8):
                    ones[64 * c + 8 * byte + bit] += value >> (7 - bit) & 1
    return [int(2 * n > len(features)) for n in ones]


def brute(rows: list[tuple[int, str]]) -> set[int]:
    """The smallest id of each component over all pairs of fingerprints."""
    made = {}
    for _, text in rows:
        if text not in made:
            made[text] = np.array(plain_print(shingles(text, 5), 8))
    low = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if np.sum(made[rows[a][1]] != made[rows[b][1]]) <= 104:
                x, y = sorted((low[a], low[b]))
                low = [x if v == y else v for v in low]
    return {rows[k][0] for k in set(low)}


def edited(rng: np.random.Generator, first: int, n: int, most: int, size: int = 300) -> list[tuple[int, str]]:
    """n edited copies of one text of `size` words, with up to `most` words exchanged."""
    base, out = [f"w{x}" for x in rng.integers(0, 5000, size)], []
    for k in range(n):
        own = list(base)
        for at in rng.choice(size, int(rng.integers(0, most + 1)), replace=False):
            own[at] = f"x{rng.integers(0, 10**9)}"
        out.append((first + k, " ".join(own)))
    return out


def kept(spark, rows: list[tuple[int, str]]) -> set[int]:
    return {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [r for g in range(20) for r in edited(rng, 10 * g, 4, 20)] + [(1000, "a b"), (1001, "A  b"), (1002, "a b c")]
    assert kept(spark, rows) == brute(rows)


def test_planted_near_copies_and_clean_documents(spark):
    """One word in fifty exchanged: at least 0.98 of the copies go, no clean document does. Shingle
    cosines from 0.85 link and those up to 0.7 don't."""
    rng = np.random.default_rng(7)
    rows, planted = [], []
    for g in range(200):
        size = int(rng.integers(60, 600))
        base = [f"w{int(x)}" for x in rng.zipf(1.2, size)]
        own = list(base)
        for at in rng.choice(size, max(1, size // 50), replace=False):
            own[at] = f"x{rng.integers(0, 10**9)}"
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(own))]
        planted.append(10 * g + 1)
    clean = [(10_000 + k, " ".join(f"w{int(x)}" for x in rng.zipf(1.2, 300))) for k in range(400)]
    got = kept(spark, rows + clean)
    assert {i for i, _ in clean} <= got and {10 * g for g in range(200)} <= got
    assert sum(i not in got for i in planted) >= 0.98 * len(planted)


def test_links_follow_the_cosine():
    rng = np.random.default_rng(8)
    for changed in (1, 3, 6, 9, 12, 15, 20, 30, 60):
        a, b = (t for _, t in edited(rng, 0, 2, 0))
        w = b.split()
        for at in rng.choice(300, changed, replace=False):
            w[at] = f"x{rng.integers(0, 10**9)}"
        x, y = shingles(a, 5), shingles(" ".join(w), 5)
        cosine = len(x & y) / math.sqrt(len(x) * len(y))
        fp = near_copies.prints([near_copies.feature_set(t.encode().split(), 5) for t in (a, " ".join(w))], 8)
        assert np.unpackbits(fp[0]).tolist() == plain_print(x, 8)
        differing = int(np.unpackbits(fp[0] ^ fp[1]).sum())
        if cosine >= 0.85:
            assert differing <= near_copies.MOST
        if cosine <= 0.7:
            assert differing > near_copies.MOST


def test_null_ids_and_texts(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, None), (6, ""), (None, "a lone text")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "'x' AS place")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    got = got.collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got if r["doc_id"] != 5) == [(0, "a lone text"), (4, "a b c d e f")] and len(got) == 3
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_a_long_text(spark):
    rng = np.random.default_rng(9)
    rows = edited(rng, 0, 3, 400, 60_000)
    assert kept(spark, rows) == {0}


def test_one_large_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(common, "RUN_CHUNK", 64)
    rows = edited(np.random.default_rng(6), 0, 150, 8)
    assert kept(spark, rows) == brute(rows)


def test_long_runs_are_dealt_finer_and_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [r for g in range(12) for r in edited(rng, 100 * g, 12, 12)]
    want = kept(spark, rows)
    monkeypatch.setattr(common, "RUN_CHUNK", 4)
    assert kept(spark, rows) == want == brute(rows)


def test_rows_moved_grow_with_the_texts(spark, monkeypatch):
    """With halves of 2,048 values as full as at many millions of texts, four times the texts move four times the rows."""
    monkeypatch.setattr(common, "RUN_CHUNK", 8)
    plain, moved = common.linked_runs, []

    def counted(rows, *more):
        moved[-1] += rows.count()
        return plain(rows, *more)

    monkeypatch.setattr(near_copies, "linked_runs", counted)
    monkeypatch.setattr(common, "linked_runs", counted)
    rng = np.random.default_rng(13)
    for n in (5_000, 20_000):  # independent texts: 2.4 and 10 rows for each value of a half
        prints = rng.integers(0, 1 << 62, (n, 11)).view(np.uint64)
        nodes = [(k, p[:3].astype(">u8").tobytes(), p[3:].tobytes()) for k, p in enumerate(prints)]
        moved.append(0)
        near_copies.linked_nodes(spark.createDataFrame(nodes, "node long, searched binary, decides binary")).count()
    assert moved[0] <= 225 * 5_000 and moved[1] <= 225 * 20_000
    monkeypatch.setattr(common, "RUN_CHUNK", 2)
    for n in (2_000, 8_000):
        prints = rng.integers(0, 1 << 62, (n, 11)).view(np.uint64)
        nodes = [(k, p[:3].astype(">u8").tobytes(), p[3:].tobytes()) for k, p in enumerate(prints)]
        moved.append(0)
        near_copies.linked_nodes(spark.createDataFrame(nodes, "node long, searched binary, decides binary")).count()
    assert moved[3] <= 225 * 8_000
