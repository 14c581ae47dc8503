"""Mixing sources to target weights by weighted fair queueing.

Every source shuffles its documents and plays them up to `epochs` times. A document's
virtual finish time is the source's words up to its end over the source's target; all
documents of all sources are range-sorted by it, and the sorted sequence is cut at the total
budget. At virtual time 1 every source has reached its target, so a document that would
only start after it isn't offered. All sums are two-level prefix sums, so a source with a
third of all rows is spread over as many tasks as any.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share the budget;
no target exceeds `epochs` times its source's words, and what lies above is shared again by
weight among the others until none is above.

Defined cases: a null text has size 0 and is never taken; null sources are one source; equal
ids tie by size and text hash, and rows equal in all are interchangeable; an empty table gives
an empty result; a budget of zero takes nothing. Reruns agree: the shuffle is a hash of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.llm.common import checkpoint, running_total, size_buckets

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
HASH_BITS = 60


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def shuffle_hash(id_col: str, seed: str, otherwise: Column) -> Column:
    """60 bits of md5(seed + id): the order of the shuffle. Rows without an id are shuffled by `otherwise`."""
    tagged = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), otherwise.cast("string"))))
    return F.conv(F.substring(F.md5(tagged), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, source: str, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """(source, rank, source_size, target) with the excess above epochs x size shared again."""
    per = sizes.groupBy(F.col(source).alias("__source")).agg(F.sum("size").alias("source_size"))
    ordered = per.repartitionByRange(F.col("__source").asc_nulls_last()).sortWithinPartitions(
        F.col("__source").asc_nulls_last()
    )
    placed = checkpoint(ordered.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__one", F.lit(1))
    ranked = running_total(placed, [], "__part", [F.col("__at")], "__one", "rank").withColumn("rank", F.col("rank") - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = checkpoint(
        ranked.select("__source", "rank", "source_size", weight.cast("long").alias("weight")).withColumn(
            "most", F.col("source_size") * epochs
        )
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # each round caps more sources, so it ends; one row per round reaches the driver
        above = F.lit(level) * F.col("weight") > F.col("most")
        fixed, free, now = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
            F.count_if(above),
        ).first()
        if now == capped or not free:
            break
        level, capped = (total - fixed) / free, now
    target = F.least(F.lit(level) * F.col("weight"), F.col("most").cast("double"))
    return sources.select("__source", "rank", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """(doc_id, text_hash, size, source_size, target, taken) per row of docs; text_hash is that of
    text and source."""
    light = checkpoint(
        docs.select(
            F.col(id_col),
            F.col(source).alias("__src"),
            F.xxhash64(text, source).alias("text_hash"),
            word_count(text).alias("size"),
            shuffle_hash(id_col, seed, F.xxhash64(text, source)).alias("__hash"),
        )
    )
    targets = source_targets(light, "__src", weights, epochs)
    rows, total = light.agg(F.count("*"), F.sum("size")).first()
    buckets = size_buckets(rows)
    width = (1 << HASH_BITS) // buckets + 1
    with_target = light.join(targets, F.col("__src").eqNullSafe(F.col("__source"))).drop("__source", "__src")
    queued = running_total(
        with_target.withColumn("__bucket", F.floor(F.col("__hash") / F.lit(width))),
        ["rank"],
        "__bucket",
        [F.col("__hash"), F.col(id_col), F.col("size"), F.col("text_hash")],
        "size",
        "end",
    ).drop("__bucket")
    # (rank, end) tells rows with words apart; rows without are never offered
    offered = (F.col("epoch") * F.col("source_size") + F.col("end") - F.col("size")) / F.col("target") < 1
    play = (
        queued.where("size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("offered", offered)
        .where("offered or epoch = 0")
        .withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("end")) / F.col("target"))
        .withColumn("__words", F.when(F.col("offered"), F.col("size")).otherwise(F.lit(0)))
        .withColumn(
            "__time",
            F.when(F.col("offered"), F.least(F.floor(F.col("finish") * buckets), F.lit(buckets))).otherwise(
                buckets + 1 + F.pmod("__hash", F.lit(buckets))
            ),
        )
    )
    sorted_play = running_total(
        play, [], "__time", [F.col("finish"), F.col("rank"), F.col("end")], "__words", "__played"
    )
    kept = F.when(F.col("offered") & (F.col("__played") <= F.lit(total or 0)), F.col("size")).otherwise(F.lit(0))
    taken = sorted_play.groupBy(id_col, "text_hash", "rank", "end", "size", "source_size", "target").agg(F.sum(kept).alias("taken"))
    return taken.select(id_col, "text_hash", "size", "source_size", "target", "taken").unionByName(
        queued.where("size = 0").select(id_col, "text_hash", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    )


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, columns as they
    were; documents that the mix doesn't take are left out. Rows that repeat id, text and source
    share what the mix takes of them evenly."""
    times = (
        mix(docs, id_col, text, source, **kw)
        .where("taken > 0")
        .groupBy(F.xxhash64(F.lit("id"), id_col).alias("__id_hash"), F.col("text_hash").alias("__hash"))
        .agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("__times"))
    )
    # two hashes that are never null: the windows and the join share one exchange of the texts
    own = docs.withColumn("__id_hash", F.xxhash64(F.lit("id"), id_col)).withColumn("__hash", F.xxhash64(text, source))
    rows = Window.partitionBy("__id_hash", "__hash")
    share = F.floor(F.col("__times") / F.col("__rows")) + (F.col("__no") <= F.col("__times") % F.col("__rows")).cast("int")
    return (
        own.withColumn("__no", F.row_number().over(rows.orderBy(F.lit(0))))
        .withColumn("__rows", F.count("*").over(rows))
        .join(times, ["__id_hash", "__hash"])
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), share.cast("int"))))
        .select(*[f"`{c}`" for c in docs.columns])
    )


def op5_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).drop("text_hash")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix' || doc_id), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
       FROM d GROUP BY source),
s AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM s0),
t AS (SELECT sum(size)::BIGINT AS total FROM d),
lv AS (
  SELECT 0 AS round, 0::DOUBLE AS level, -1::BIGINT AS capped
  UNION ALL
  SELECT round + 1,
         ((SELECT total FROM t) - (SELECT coalesce(sum(most), 0) FROM s WHERE level * weight > most))::DOUBLE
           / (SELECT sum(weight) FROM s WHERE level * weight <= most)::DOUBLE,
         (SELECT count(*) FROM s WHERE level * weight > most)
  FROM lv WHERE round < 40),
tg AS (SELECT s.*, least((SELECT max_by(level, round) FROM lv) * weight, most::DOUBLE) AS target FROM s),
q AS (SELECT doc_id, size, h, rank, source_size, target,
             sum(size) OVER (PARTITION BY rank ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS fin
      FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source),
p AS (SELECT q.*, e.epoch, (e.epoch * source_size + fin)::DOUBLE / target AS finish
      FROM q, (VALUES (0), (1), (2)) e(epoch)
      WHERE size > 0 AND (e.epoch * source_size + fin - size)::DOUBLE / target < 1),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, fin ROWS UNBOUNDED PRECEDING) AS played FROM p),
k AS (SELECT rank, fin, sum(size)::BIGINT AS taken FROM c WHERE played <= (SELECT total FROM t) GROUP BY rank, fin)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(CASE WHEN q.size > 0 THEN k.taken END, 0)::BIGINT AS taken
FROM q LEFT JOIN k ON q.rank = k.rank AND q.fin = k.fin
"""
