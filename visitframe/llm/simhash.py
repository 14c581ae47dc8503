"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint has 64 bits; bit k is set if it is set in over half of the XXH64
hashes (seed 42) of the document's word shingles. Fingerprints link at `distance` or fewer
differing bits.

Candidate search: with at most 4 differing bits over 3 segments, one segment differs in at
most one bit. Each distinct fingerprint is therefore indexed under its 3 segments as they
are and under every variant with one bit of a segment replaced by a wildcard (64 more). Two
fingerprints whose segment is equal meet under the segment, two whose segment differs in
one bit meet under the variant that wildcards it. Every meeting pair that isn't connected yet is
verified on all 64 bits, so no connection is lost and no link is false.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer
words than a shingle make one shingle of the whole sequence; equal fingerprints (exact copies
among them) are one node, so copies are never expanded into pairs; repeated rows share the
component; rows with a null id link like others, but name a component only if it has no other
id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.llm.common import checkpoint, connected_components, hot_join, linked_runs, spanning_pairs, text_slices

SEED = 42
#: Hashes whose bits are added up at once.
FLUSH = 1 << 16
#: Bits of the segments; one fewer than half the distance would suffice for exact segments.
SEGMENTS = (22, 21, 21)


def fingerprint_batch(texts: list[str | None], words: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints. Bytes are split at 0x20 and 0x09-0x0D, which is what
    bytes.split() does; bytes.lower() changes A-Z alone."""
    digest = xxhash.xxh64_intdigest
    ones, counts = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    parts: list[tuple[int, int]] = []

    def add_up() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
            at, sizes = np.array(parts).T
            # a text may have come in several parts, the parts of one flush are of different texts
            ones[at] += np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
            counts[at] += sizes
            hashes.clear()
            parts.clear()

    for i, text in enumerate(texts):
        w = text.encode().lower().split() if text else []
        shingles = max(len(w) - words + 1, min(len(w), 1))
        for lo in range(0, shingles, FLUSH):
            own = [digest(b" ".join(w[k : k + words]), SEED) for k in range(lo, min(lo + FLUSH, shingles))]
            hashes += own
            parts.append((i, len(own)))
            if len(hashes) >= FLUSH:
                add_up()
    add_up()
    return np.packbits(ones * 2 > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 2):
                fp = fingerprint_batch(batch.column(2).to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=[id_col, "text_hash", "fp"]
                )

    picked = docs.select(id_col, F.xxhash64(text).alias("text_hash"), text)
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, text_hash long, fp long")


def segment_keys(fps: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of unsigned fingerprints, for each segment and each of its one-wildcard variants."""
    kind, low = 0, 0
    for width in SEGMENTS:
        part = (fps >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
        for bit in range(-1, width):
            yield kind << 22 | part & ~(0 if bit < 0 else 1 << bit)
            kind += 1
        low += width


def signatures(distinct: DataFrame) -> DataFrame:
    """(key, node): each fp under its segments and their one-wildcard variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for key in segment_keys(fp.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], names=["key", "node"])

    return distinct.select("fp").mapInArrow(run, "key long, node long")


def _linker(distance: int):
    def link(cols: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fp = cols["node"].view(np.uint64)
        yield from spanning_pairs(starts, lambda i, j: np.bitwise_count(fp[i] ^ fp[j]) <= distance)

    return link


def _components(known: DataFrame, id_col: str, distance: int) -> DataFrame:
    """(fp, component, first_id, __rows) per distinct fp of known: component is the smallest fp of its
    component, first_id the smallest id of its rows, of which there are __rows."""
    if not 0 <= distance <= 2 * len(SEGMENTS) - 1:
        raise ValueError("with three segments and one wildcard the distance is 5 at most")
    distinct = known.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count("*").alias("__rows"))
    edges = linked_runs(signatures(distinct), _linker(distance))
    parts = connected_components(edges).withColumnRenamed("node", "fp")
    return distinct.join(parts, "fp", "left").select("fp", "component", "first_id", "__rows")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4
) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id is the smallest id reachable
    over links, itself included. distance may be 0 to 5: one bit per segment at most."""
    known = checkpoint(fingerprints(docs, id_col, text, words))
    linked = _components(known, id_col, distance)
    smallest = linked.where("component is not null").groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = linked.join(smallest, "component", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id"), "__rows"
    )
    # copies of one text are as many rows of one fp; those of hot ones are dealt over all tasks
    return hot_join(known, checkpoint(by_fp), ["fp"], [id_col], rows="__rows").select(id_col, "fp", "component_id")


def op4_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
