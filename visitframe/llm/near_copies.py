"""Near copies by SimHash with deletion-variant signatures, for similarities that 4 of 64 bits can't reach.

The similarity of two texts is the cosine of their sets of five-word shingles, which is what the differing bits of
SimHash fingerprints estimate: texts link if 512-bit fingerprints of these sets differ in at
most 104 bits, the share at a cosine of 0.8. (A Jaccard similarity of 0.8 is a cosine of 0.89 or more.)

Candidates come from the same search as in simhash, over fingerprints that a near copy changes less: three of 64 bits
of the set of single words, nine segments in all. Texts meet if any of the nine segments differs in at most one
bit; that is sure up to 17 of the 192 bits, and beyond it depends on how the bits fall (measured in the
README). Two texts that differ in at most one bit of a segment share its upper or its lower half. So each goes once to
either half of a segment, 18 rows instead of the 198 of all variants, and the one-wildcard variants of the other
half are indexed and joined where these rows lie.

A half has 2,048 values, so from some two million texts on some halves are shared by more rows than one task takes (common.RUN_CHUNK).
The rows of these, and only they, move once more, under the one-wildcard variants of the other half: at most 23 for
each segment, 207 in all, whatever the number of texts. From there the work is that of simhash over 2^21 segment values: what
moves per text is bounded up to some ten billion texts, and grows with the rows of a segment value beyond.

Defined cases: texts with equal shingle sets are one node, of texts with equal hashes (64 bits) one stays, so copies are never expanded into pairs; null and wordless
texts have the empty set and link with one another alone; fewer words than a shingle make one shingle of
the whole sequence; long texts are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitframe.llm.common import checkpoint, connected_components, linked_runs, merged_roots, spanning_pairs, text_slices
from visitframe.llm.simhash import SEED, SEGMENTS

#: Texts link from this cosine.
LEAST = 0.8
#: Bits of the fingerprint of shingles that decides, and how many of them may differ.
BITS = 512
MOST = int(BITS * math.acos(LEAST) / math.pi)
#: Fingerprints of 64 bits of the words that are searched.
PRINTS = 3
#: Bits of the lower half of a segment, and the most of the upper one.
HALF = 11
#: Features whose bits are added up at once, in lanes of a byte.
LANES = 255
BLOCK = 128 * LANES
#: 64 bits with bit k of a byte in the lane of byte k.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def feature_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words."""
    digest = xxhash.xxh64_intdigest
    n = max(len(words) - size + 1, min(len(words), 1))
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + size]), SEED) for k in range(n)), np.uint64, n))


def draws(features: np.ndarray, count: int) -> np.ndarray:
    """n x count hashes of 64 bits drawn from each feature (the mixing of splitmix64)."""
    steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = features[:, None] + steps
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def prints(sets: list[np.ndarray], count: int) -> np.ndarray:
    """len(sets) x 8 count bytes: bit k is set if it is in over half of the set's draws."""
    ones = np.zeros((len(sets), 64 * count), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []

    def add_up() -> None:
        if held:
            lanes = SPREAD[draws(np.concatenate(held), count).view(np.uint8)]
            sizes = np.array([len(h) for h in held])
            sums = np.add.reduceat(lanes, np.cumsum(sizes) - sizes, axis=0)
            np.add.at(ones, owners, sums.view(np.uint8).reshape(len(held), -1))
            held.clear()
            owners.clear()

    total = 0
    for i, own in enumerate(sets):
        for lo in range(0, len(own), LANES):
            held.append(own[lo : lo + LANES])
            owners.append(i)
            total += len(held[-1])
            if total >= BLOCK:
                add_up()
                total = 0
    add_up()
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1)


def sketches(docs: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """(id, text_hash, node, searched, decides): node is a hash of the shingle set, searched and decides are the
    fingerprints of words and of shingles, null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 2):
                split = [x.encode().lower().split() if x else [] for x in batch.column(2).to_pylist()]
                sets = [feature_set(w, words) for w in split]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                none = np.array([not len(s) for s in sets])
                searched = [r.tobytes() for r in prints([feature_set(w, 1) for w in split], PRINTS)]
                decides = [r.tobytes() for r in prints(sets, BITS // 64)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(nodes)] + [pa.array(c, pa.binary(), mask=none) for c in (searched, decides)],
                    names=[id_col, "text_hash", "node", "searched", "decides"],
                )

    picked = docs.select(id_col, F.xxhash64(text).alias("text_hash"), text)
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, text_hash long, node long, searched binary, decides binary")


def half_rows(nodes: DataFrame) -> DataFrame:
    """(key, node, rest, half, decides): each node twice for each of its nine segments, under the segment's upper and under its
    lower half; rest is the other half. Half 0 are the upper ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").astype(np.uint64).reshape(-1, PRINTS)
            for number in range(PRINTS):
                low = 0
                for place, width in enumerate(SEGMENTS):
                    part = (fps[:, number] >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
                    low += width
                    upper, lower = part >> HALF, part & ((1 << HALF) - 1)
                    for half, (own, rest) in enumerate(((upper, lower), (lower, upper))):
                        kind = (number * len(SEGMENTS) + place) * 2 + half
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(kind << HALF | own), batch.column(0), pa.array(rest.astype(np.int32)), pa.array(np.full(len(own), half, np.int8)), batch.column(2)],
                            names=["key", "node", "rest", "half", "decides"],
                        )

    searched = nodes.where("searched is not null").select("node", "searched", "decides")
    return searched.mapInArrow(run, "key long, node long, rest int, half byte, decides binary")


def _link(cols: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a run, whose rows share half a segment, that share the other half or a one-wildcard variant of it."""
    held, rest = cols["decides"].view(np.uint64), cols["rest"].astype(np.int64)
    n = len(rest)
    run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    root = np.arange(n)
    for bit in range(-1, HALF):
        local = run << HALF | (rest if bit < 0 else rest & ~(1 << bit))
        rows = np.argsort(local, kind="stable")
        if bit < 0:  # equal segments meet under the upper half alone
            rows = rows[cols["half"][rows] == 0]
        if not len(rows):
            continue
        here = local[rows]
        first = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        sizes = np.diff(np.append(first, len(rows)))
        own, value = root[rows], rest[rows]
        useful = (sizes > 1) & (np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first))
        if bit >= 0:  # a variant whose rows all have the same bit adds nothing
            useful &= np.minimum.reduceat(value, first) < np.maximum.reduceat(value, first)
        rows, sizes = rows[np.repeat(useful, sizes)], sizes[useful]
        if not len(rows):
            continue
        prints = held[rows]

        def near(i: np.ndarray | int, j: np.ndarray, prints: np.ndarray = prints) -> np.ndarray:
            return np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64) <= MOST

        found = list(spanning_pairs(np.concatenate([[0], np.cumsum(sizes)]), near))
        if found:
            i, j = (rows[np.concatenate(side)] for side in zip(*found, strict=True))
            yield i, j
            root = merged_roots(root, i, j)


def _near(cols: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of runs whose rows share a segment but one bit at most."""
    held = cols["decides"].view(np.uint64)
    yield from spanning_pairs(starts, lambda i, j: np.bitwise_count(held[i] ^ held[j]).sum(axis=1, dtype=np.int64) <= MOST)


def finer_rows(rows: DataFrame) -> DataFrame:
    """(key, node, decides): rows of half_rows under their whole segment (those of the upper half) and the one-wildcard variants of
    the half that they don't share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rest, half = (batch.column(c).to_numpy() for c in ("key", "rest", "half"))
            for bit in range(-1, HALF):
                at = np.flatnonzero(half == 0) if bit < 0 else np.arange(len(key))
                own = (key[at] << 4 | bit + 1) << HALF | rest[at].astype(np.int64) & ~(0 if bit < 0 else 1 << bit)
                picked = batch.select(["node", "decides"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(own), *picked.columns], names=["key", "node", "decides"])

    return rows.mapInArrow(run, "key long, node long, decides binary")


def linked_nodes(nodes: DataFrame) -> DataFrame:
    """(node, component) of the nodes that link with others."""
    return connected_components(linked_runs(half_rows(nodes), _link, (finer_rows, _near)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """docs without near copies: of each component exactly one row stays, that with the smallest
    id (null last), then text hash."""
    known = sketches(docs, id_col, text, words)
    place = F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"), F.col("text_hash"))
    nodes = checkpoint(
        known.groupBy("node").agg(F.min(place).alias("place"), F.first("searched").alias("searched"), F.first("decides").alias("decides"))
    )
    parts = linked_nodes(nodes)
    where = [F.xxhash64(F.lit("id"), "place.id").alias("__id_hash"), F.col("place.text_hash").alias("__hash")]
    keep = (
        nodes.select("node", "place").join(parts, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("root"))
        .agg(F.min("place").alias("place"))
        .select(*where)
    )
    # two hashes that are never null: the join and the window share one exchange of the texts
    own = docs.withColumn("__id_hash", F.xxhash64(F.lit("id"), id_col)).withColumn("__hash", F.xxhash64(text))
    kept = own.join(keep, ["__id_hash", "__hash"], "left_semi")
    again = Window.partitionBy("__id_hash", "__hash").orderBy(F.lit(0))
    return kept.withColumn("__no", F.row_number().over(again)).where("__no = 1").select(*[f"`{c}`" for c in docs.columns])
