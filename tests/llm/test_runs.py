"""Periodic runs: against all periods and starts, linear work, and the query's digests."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from visitframe.llm import lyndon_runs as lr


def plain_runs(w: list, least: int, periods: int) -> list[tuple[int, int, int]]:
    found = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            e = i + p
            smallest = not any(all(w[x] == w[x + q] for x in range(s, e - q)) for q in range(1, p))
            if smallest and e - s >= max(least, periods * p):
                found.append((s, e - s, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_against_all_periods():
    rng = random.Random(1)
    for _ in range(4000):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.6 and n > 4:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least, periods in ((1, 2), (4, 3), (24, 3)):
            assert lr.runs_of(w, least, periods) == plain_runs(w, least, periods), w


def fibonacci(n: int) -> list[int]:
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("n", [3000, 30000])
def test_work_is_linear(n):
    rng = random.Random(2)
    words = {
        "fibonacci": fibonacci(n),
        "thue_morse": [i.bit_count() & 1 for i in range(n)],
        "one": [0] * n,
        "ruler": [(i & -i).bit_length() for i in range(1, n + 1)],
        "random": [rng.randrange(2) for _ in range(n)],
        "periodic": [rng.randrange(2) for _ in range(50)] * (n // 50),
        "repeated_fibonacci": fibonacci(377) * (n // 377),
        "growing": sum(([0] * k + [1] for k in range(int((2 * n) ** 0.5))), []),
        "shrinking": sum(([0] * k + [1] for k in range(int((2 * n) ** 0.5), 0, -1)), []),
    }
    for name, w in words.items():
        for sign in (1, -1):
            assert lr.edges([sign * c for c in w], 1, 2, set()) <= 2.5 * n, name


def expected(doc_id: int | None, text: str | None) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 24, 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (
        len(runs),
        *best,
        None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(words) if i not in gone)).hexdigest(),
    )


FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_plain_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    short = [i for i, t in texts.items() if len((t or "").split()) < 700]
    got = {r["doc_id"]: tuple(r[c] for c in FIELDS) for r in lr.op11_periodic_runs(docs).collect()}
    assert len(got) == len(texts) and len(short) > 100
    assert {i: got[i] for i in short} == {i: expected(i, texts[i]) for i in short}


def test_defined_cases(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(200))), "x") for k in range(60)]
    rows += [(70, None, None), (71, "", ""), (72, " \t\n\x0b\x0c\r", ""), (None, "ab " * 30, "x"), (None, None, None), (75, "y y " * 30, "x")]
    rows += [(76, "a b c " * 400, "x"), (76, "a b c " * 400, "x"), (77, "word " * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, *(str(r[c]) for c in FIELDS)) for r in lr.op11_periodic_runs(docs).collect()))
    short = [r for r in rows if len(r[1] or "") < 10_000]
    want = [(i is None, i or 0, *map(str, expected(i, t))) for i, t, _ in short]
    assert [r for r in got if r[1] != 77] == sorted(want)
    long = next(r for r in got if r[1] == 77)
    assert long[2:6] == ("1", "0", "300000", "1")
    assert lr.op11_periodic_runs(docs.limit(0)).count() == 0
    whole = lr.find_runs(docs.where("doc_id = 76")).first()
    assert whole["collapsed"] == b"a b c" and [tuple(r) for r in whole["runs"]] == [(0, 1200, 3)]
