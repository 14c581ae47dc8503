"""Toxicity by logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

A text's features are its distinct words, pairs and triples of neighbouring words, and pairs of words two and three apart,
each hashed to one of BUCKETS coordinates. FTRL-proximal keeps a rate of its own for each coordinate and leaves the weights
of those that the gradient doesn't carry past L1 at exactly zero, so that what travels to the tasks is the list of the
others, at most BUCKETS of them whatever the input.

The fit takes a bounded sample of the labelled texts, `sample_bytes` of each label, drawn by a hash of the id among all of
them; texts over `longest_bytes` aren't learned from. So where label 1 is rare and labels abound, the two are learned from
about equally and 0.5 parts them without regard to how rare it is. Scoring covers whole texts.

Defined cases: a null, empty or wordless text has no feature and gets the intercept's score; labels other than 0 and 1
(null among them) aren't learned from; without labelled rows, or with one label only, the score is the share of label 1 (0.5
without rows); an id that has several labels counts with each; a null id is held out of nothing and has no label; repeated rows get the same answer; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from visitframe.llm.common import text_slices

BUCKETS = 1 << 20
#: ASCII that isn't a letter or a digit parts words.
PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Distances of the second word of a skip-gram.
SKIPS = (2, 3)
#: Words whose hashes a task keeps.
WORDS_KEPT = 200_000
#: Draws lie below 2^DRAW_BITS; LEVELS steps for each doubling bound how many are taken.
DRAW_BITS = 40
LEVELS = 16


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(PARTS).split() if text else []


def word_hashes(docs: list[list[bytes]], memory: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the words of docs, one document after the other."""
    if len(memory) > WORDS_KEPT:
        memory.clear()
    for w in set().union(*docs):
        if w not in memory:
            memory[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(memory.__getitem__, chain.from_iterable(docs)), np.uint64, sum(map(len, docs)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ x >> np.uint64(27)) >> np.uint64(24)).astype(np.int64) & (BUCKETS - 1)


def features(hashes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position of the first word, coordinate) of each kind of feature; none reaches over a document's end."""
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    at = np.arange(len(hashes))
    yield at, _mixed(hashes)
    spread = np.uint64(0x9E3779B97F4A7C15)
    for far in (1, *SKIPS):
        own = at[at + far < end]
        pair = hashes[own] * spread + hashes[own + far] + np.uint64(far)
        yield own, _mixed(pair * spread)
        if far == 2:
            triple = (hashes[own] * spread + hashes[own + 1]) * spread + hashes[own + 2]
            yield own, _mixed(triple * spread + np.uint64(7))


@dataclass
class Model:
    at: np.ndarray  # coordinates with a weight, sorted
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None], memory: dict[bytes, int], table: np.ndarray) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        ends = np.cumsum([len(d) for d in docs], dtype=np.int64)
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        held = []
        for first, coordinate in features(word_hashes(docs, memory), ends):
            hit = table[coordinate] != 0
            held.append(owner[first[hit]] * BUCKETS + coordinate[hit])
        distinct = np.unique(np.concatenate(held))
        total = np.bincount(distinct // BUCKETS, table[distinct % BUCKETS], len(docs)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.at] = self.weights
        return out


def fit(
    docs: list[np.ndarray],
    labels: list[int],
    share: float,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 6.0,
    l2: float = 0.1,
    rounds: int = 6,
    seed: int = 11,
) -> Model:
    """FTRL-proximal over documents given as distinct coordinates. `share`, that of label 1 among all labelled rows, is the
    score where nothing can be learned."""
    if not 0 < sum(labels) < len(labels):
        bound = min(max(share, 1e-200), 1 - 1e-16)
        return Model(np.zeros(0, np.int64), np.zeros(0), math.log(bound) - math.log1p(-bound))
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rng = np.random.default_rng(seed)
    penalty = np.full(BUCKETS + 1, l1)
    penalty[BUCKETS] = 0  # the intercept is the last coordinate

    def weight(at: np.ndarray) -> np.ndarray:
        own = z[at]
        over = np.maximum(np.abs(own) - penalty[at], 0)
        return -np.sign(own) * over / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(rounds):
        for d in rng.permutation(len(docs)).tolist():
            at = np.append(docs[d], BUCKETS)
            w = weight(at)
            g = 1 / (1 + math.exp(-min(max(float(w.sum()), -500), 500))) - labels[d]
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            n[at] = after
    w = weight(np.arange(BUCKETS + 1))
    at = np.flatnonzero(w[:BUCKETS])
    return Model(at, w[at], float(w[BUCKETS]))


def training_sample(
    docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str, text: str, label: str, sample_bytes: int, longest_bytes: int
) -> tuple[list[np.ndarray], list[int], float]:
    """Distinct coordinates and labels of the drawn texts, and the share of label 1 among all that may be drawn."""
    given = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label"))
    draw = F.pmod(F.xxhash64("__id", F.lit("draw")), F.lit(1 << DRAW_BITS))
    level = F.floor(F.log2(draw + 1) * LEVELS).cast("int")
    own = docs.where(may_learn).select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    own = own.withColumn("__level", level).withColumn("__size", F.coalesce(F.octet_length("__text"), F.lit(0)) + 64)
    sizes = F.sum(F.when(F.col("__size") <= longest_bytes, F.col("__size")).otherwise(0))
    counts = own.drop("__text").join(given, "__id").groupBy("__label", "__level").agg(F.count("*").alias("n"), sizes.alias("size"))
    by_label: dict[int, list] = {0: [], 1: []}
    for r in counts.orderBy("__label", "__level").collect():  # DRAW_BITS * LEVELS rows a label at most
        by_label[r["__label"]].append(r)
    total = {k: sum(r["n"] for r in rows) for k, rows in by_label.items()}
    share = total[1] / (total[0] + total[1]) if total[0] + total[1] else 0.5
    below = {}
    for k, rows in by_label.items():
        spent, below[k] = 0, 0
        for r in rows:
            spent += r["size"]
            if spent > sample_bytes:
                break
            below[k] = r["__level"] + 1
    # only the share of the texts that is drawn moves
    drawn = own.where((F.col("__size") <= longest_bytes) & (F.col("__level") < max(below.values()))).join(given, "__id")
    drawn = drawn.where(F.col("__level") < F.when(F.col("__label") == 1, below[1]).otherwise(below[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for t in batch.column(2).to_pylist():
                own = [words_of(t)]
                found = features(word_hashes(own, memory), np.array([len(own[0])]))
                out.append(np.unique(np.concatenate([c for _, c in found])).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["level", "label", "at"])

    rows = drawn.select("__level", "__label", "__text").mapInArrow(run, "level int, label int, at binary").orderBy("level", "label", "at").toArrow()
    return [np.frombuffer(b, np.int32) for b in rows["at"].to_pylist()], rows["label"].to_pylist(), share


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    may_learn: Column | None = None,
    sample_bytes: int = 12 << 20,
    longest_bytes: int = 1 << 20,
    **settings: float,
) -> DataFrame:
    """(id, score) per row of docs, learned from the rows of docs with a label where `may_learn` holds (all by default)."""
    model = fit(*training_sample(docs, labels, F.lit(True) if may_learn is None else may_learn, id_col, text, label, sample_bytes, longest_bytes), **settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memory, table = {}, model.table()
        for whole in batches:
            for batch in text_slices(whole, 1):
                found = model.scores(batch.column(1).to_pylist(), memory, table)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[id_col, "score"])

    picked = docs.select(id_col, F.col(text).alias("__text"))
    return picked.mapInArrow(run, StructType([picked.schema[0]]).add("score", DoubleType()))


def op13_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = held_out("doc_id")
    return score(docs, labels, may_learn=~out).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
