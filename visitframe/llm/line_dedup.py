"""Line deduplication by overlapping three-line windows.

Every three consecutive lines of a document are hashed (128 bits). A window that occurs more
than once keeps its first occurrence in the order of (doc_id, text hash, line); the lines of
all later occurrences are covered, overlapping windows merge, and covered lines go. Nothing
but column expressions, aggregates and joins; the first occurrence is a map-side combined
minimum, so a window that a third of all documents share is no bottleneck.

With `ends` (the corpus pipeline; op7 is defined by its SQL, without) a mark stands before the
first and after the last line: the first two and the last two lines are windows as well, and a
document of one line or two is covered if another one repeats it whole, or begins or ends with
its two lines.

Defined cases: a null text stays null and has no lines; documents with fewer lines than a
window have no window and stay whole, but for `ends`; windows of blank lines only don't count; rows that
repeat both id and text are one document and keep the same lines; a document whose lines
all go is left with an empty text; null ids come first in the order; columns of the input
named like an output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.llm.common import checkpoint, hot_join


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 3, ends: bool = False) -> DataFrame:
    """(__id, __text_hash, removed): the sorted positions, from 0, of the lines that go, for
    the documents that lose any. With `ends` the positions of the marks (-1 and the number of
    lines) may be among them."""
    lines = docs.where(F.col(text).isNotNull()).select(
        F.col(id_col).alias("__id"), F.xxhash64(text).alias("__text_hash"), F.split(text, "\n").alias("__lines")
    )

    pad = 1 if ends else 0

    def at(i):
        own = [F.get("__lines", i + k) for k in range(window)]
        if ends:  # hashes skip nulls, so the marks are told apart by flags
            own = [F.coalesce(line, F.lit("")) for line in own] + [(i < 0).cast("string"), (i + window > F.size("__lines")).cast("string")]
        return F.struct(
            i.alias("pos"),
            F.xxhash64(*own).alias("h1"),
            F.xxhash64(F.lit("second"), *own).alias("h2"),
            (F.trim(F.concat(*own[:window])) != "").alias("full"),
        )

    windows = (
        lines.where(F.size("__lines") + 2 * pad >= window)
        .select(
            "__id",
            "__text_hash",
            F.explode(F.transform(F.sequence(F.lit(-pad), F.size("__lines") + (pad - window)), at)).alias("w"),
        )
        .where("w.full")
        .select("w.h1", "w.h2", F.struct("__id", "__text_hash", "w.pos").alias("place"))
    )
    first = checkpoint(
        windows.groupBy("h1", "h2")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
        .where("first != last")
        .drop("last")
    )
    covered = F.array_distinct(
        F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (window - 1))))
    )
    return (
        hot_join(windows, first, ["h1", "h2"], ["place"])
        .where("place > first")
        .groupBy("place.__id", "place.__text_hash")
        .agg(F.collect_set("place.pos").alias("starts"))
        .select("__id", "__text_hash", F.array_sort(covered).alias("removed"))
    )


def remove_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 3, ends: bool = False
) -> DataFrame:
    """docs with `text` without the lines that repeat, plus `n_lines` and `n_removed`."""
    removed = repeated_lines(docs, id_col, text, window, ends).withColumnRenamed("removed", "__removed")
    lines = F.split(text, "\n")
    gone = F.filter("__removed", lambda i: (i >= 0) & (i < F.size(lines))) if ends else F.col("__removed")

    def rebuilt(own: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("__removed"))
        return F.array_join(F.transform(kept, lambda i: F.get(own, i)), "\n")

    joined = docs.join(
        removed, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__text_hash")), "left"
    )
    return (
        joined.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)))
        .withColumn("n_removed", F.coalesce(F.size(gone), F.lit(0)))
        .withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
        .withColumn(
            text,
            # the outer function binds the lines to its variable, so that a text is split once
            F.when(F.col("__removed").isNull(), F.col(text)).otherwise(F.get(F.transform(F.array(lines), rebuilt), F.lit(0))),
        )
        .drop("__id", "__text_hash", "__removed")
    )


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeated_lines(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("n_lines").cast("long"),
        F.col("n_removed").cast("long"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("kept_md5"),
    )


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, unnest(range(0, len(ls) - 2)) AS pos, ls FROM l WHERE len(ls) >= 3),
h AS (
  SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win FROM w
  WHERE trim(ls[pos + 1] || ls[pos + 2] || ls[pos + 3]) <> ''),
o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS no FROM h),
c AS (SELECT DISTINCT doc_id, pos + k AS line FROM o, (VALUES (0), (1), (2)) t(k) WHERE no > 1),
x AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS own FROM l),
k AS (
  SELECT x.doc_id, string_agg(own, chr(10) ORDER BY x.line) AS kept FROM x
  LEFT JOIN c ON c.doc_id = x.doc_id AND c.line = x.line WHERE c.line IS NULL GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       md5(coalesce(kept, '')) AS kept_md5
FROM l LEFT JOIN k ON k.doc_id = l.doc_id LEFT JOIN n ON n.doc_id = l.doc_id
"""
