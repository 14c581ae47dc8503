"""Periodic runs of words in linear time, after Ellert and Fischer: two Lyndon arrays, no suffix structure and no hash.

A run is a stretch of words with smallest period q that can't be extended on either side. Its first root that is a
Lyndon word, under the order in which the word behind the run is smaller than the word q before it or under the opposite
order, is the longest Lyndon word that starts there. So the Lyndon arrays of both orders hold an edge (j, i), i - j = q,
for every run. The alphabet is only ordered: words get numbers as they are met.

One pass from left to right keeps a stack of smaller suffixes. Each comparison of the suffixes at j and i
needs the length of their common prefix, and three rules spare matching words anew:

* inside a stretch that is known to repeat what lies `shift` words before, the answer is that of the mirrored comparison,
  unless it reaches the end of the stretch, from where matching goes on;
* down the stack, the common prefix of (stack below j, i) is the smaller of those of (below j, j) and (j, i) if
  they differ, and at least as long if they don't;
* the extension of a run to the left is taken from its mirror image in the same way.

So the furthest word that was matched only moves ahead. `edges` returns the number of words it compared, which the tests
hold against a multiple of the length on Fibonacci, Thue-Morse and other repetitive words.

Defined cases: a null text has no words and no runs; a null id replaces nothing; repeated rows and ids get
each their own result; columns of the documents other than id and text don't come through, so names can't clash; an
empty table gives an empty result. A text is worked on whole, by one task, with some 300 bytes a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from visitframe.llm.common import text_slices

#: Shortest run of the query, in words and in periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3

Run = tuple[int, int, int]


def edges(w: list[int], least: int, periods: int, found: set[Run]) -> int:
    """Add the runs (start, length, period) of w whose last word but one period is followed by a smaller word, or
    that end w, of at least max(least, periods * period) words; periods is 2 or more. Returns the number of word comparisons
    beyond the first of each pair."""
    n = len(w)
    below = [-1] * n  # previous smaller suffix
    above = [n] * n  # next smaller suffix: the Lyndon array is above[j] - j
    lcp_below = [0] * n  # common prefix of (below[i], i)
    lcp_above = [0] * n  # common prefix of (j, above[j])
    far, lo, shift = 0, 0, 0  # w[x] == w[x - shift] for lo <= x < far
    starts: dict[Run, int] = {}  # run start by edge and right end, for mirrored extensions
    ends: dict[int, int] = {}  # end of the last run by period
    spent = 0
    for i in range(1, n):
        c = w[i]
        j = i - 1
        b = w[j]
        if b < c:
            below[i] = j
            continue
        k = 0  # what (j, i) are known to share
        known = -1  # or exactly what they share
        while True:
            if known >= 0:
                k = known
            elif k == 0 and b != c:
                pass
            else:
                # the mirrored comparison, if both suffixes start in the stretch that repeats
                if i < far and j >= lo:
                    x, y = j - shift, i - shift
                    m = lcp_above[x] if above[x] == y else lcp_below[y] if below[y] == x else 0
                    if m > k:
                        k = min(m, far - i)
                    exact = m < far - i and m > 0
                else:
                    exact = False
                if not exact:
                    at = i + k
                    while at < n and w[at] == w[j + at - i]:
                        at += 1
                    spent += at - i - k
                    k = at - i
                if i + k > far:
                    far, lo, shift = i + k, i, i - j
            e = i + k
            if e < n and w[j + k] < w[e]:
                below[i] = j
                lcp_below[i] = k
                break
            above[j] = i
            lcp_above[j] = k
            p = i - j
            if k and k + 2 * p > (periods * p if periods * p > least else least) and ends.get(p) != e:
                # the first Lyndon root of a run, or a later one of a run that was met by its first
                s = j
                if j >= lo and e < far:
                    mirror = starts.get((j - shift, p, e - shift))
                    if mirror is not None:
                        s = max(mirror + shift, lo)
                first = s
                while s and w[s - 1] == w[s - 1 + p]:
                    s -= 1
                spent += first - s
                starts[j, p, e] = s
                ends[p] = e
                if e - s >= max(least, periods * p):
                    found.add((s, e - s, p))
            last, j = j, below[j]
            if j < 0:
                break
            # (j, last) are known, and so are (last, i)
            b = w[j]
            m = lcp_below[last]
            if m < k:
                below[i] = j
                lcp_below[i] = m
                break
            known = k if m > k else -1
    return spent


def runs_of(codes: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[Run]:
    """Runs (start, length, period) of at least max(least, periods * period) symbols, by start, then period."""
    found: set[Run] = set()
    if len(codes) >= least:
        edges(codes, least, periods, found)
        edges([-c for c in codes], least, periods, found)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run covers after its first period, joined by one space."""
    out: list[bytes] = []
    at = 0
    for lo, hi in sorted((s + q, s + length) for s, length, q in runs):
        if hi > at:
            out += words[at : max(lo, at)]
            at = hi
    return b" ".join(out + words[at:])


def planted(n: int, h: int) -> tuple[int, int] | None:
    """(a, p) of the replacement that the query's contract asks for: from word a on, words repeat with period p."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    least: int = LEAST_WORDS,
    periods: int = LEAST_PERIODS,
    replace: Callable[[int, int], tuple[int, int] | None] | None = None,
) -> DataFrame:
    """(id, runs, collapsed) per row: the runs as an array of (start, length, period), and the text without their
    repeats. `replace(words, crc32 of the id)` may name a start and a period that the words are made to repeat with first."""
    picked = docs.select(id_col, F.col(text).cast("binary").alias("__text"), F.crc32(F.col(id_col).cast("string")).alias("__h"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                all_runs, texts = [], []
                number: dict[bytes, int] = {}
                for body, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    words = body.split() if body else []
                    change = replace(len(words), h) if replace and h is not None else None
                    if change:
                        a, p = change
                        part = words[a : a + p]
                        times, rest = divmod(len(words) - a, p)
                        words[a:] = part * times + part[:rest]
                    own = runs_of([number.setdefault(x, len(number)) for x in words], least, periods)
                    all_runs.append([{"start": s, "length": m, "period": q} for s, m, q in own])
                    texts.append(collapsed(words, own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(all_runs, kind), pa.array(texts, pa.binary())], names=[id_col, "runs", "collapsed"]
                )

    one = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())
    schema = StructType([docs.select(id_col).schema[0]]).add("runs", ArrayType(one)).add("collapsed", BinaryType())
    return picked.mapInArrow(run, schema)


def _first_by_exponent(a: Column, b: Column) -> Column:
    """Greatest length / period first, compared exactly; then smallest start, then period."""
    x, y = a["length"] * b["period"], b["length"] * a["period"]
    rest = F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"]))
    return F.when(x > y, -1).when(x < y, 1).otherwise(rest.cast("int"))


def op11_periodic_runs(docs: DataFrame) -> DataFrame:
    found = find_runs(docs, replace=planted)
    best = F.get(F.array_sort("runs", _first_by_exponent), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("best.length * 1000 div best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
