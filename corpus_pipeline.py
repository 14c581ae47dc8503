"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, SentencePiece.

Each stage takes the documents its predecessor kept, all of them, and returns the columns of
`documents`; the last returns token ids. Every stage calls one operator of visitframe.llm with
production parameters.

Defined cases, for every stage: columns beyond those of `documents` pass through to the last, whatever
their names; rows that repeat count as rows; an empty table gives an empty result; long texts are taken
whole. Null and empty texts have no identified language, so they end with the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.llm import crf_language, line_dedup, mixing, near_copies, pieces
from visitframe.llm.common import written
from visitframe.llm.registry import piece_model_bytes


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language (null texts and those without a letter among them) go;
    `lang` is what was identified."""
    return crf_language.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows, marks at both ends of a document
    included, go from the texts, and documents of which nothing is left go altogether. The first occurrence
    is that of the smallest (id, text hash, line), null ids first; null texts stay null."""
    found = line_dedup.remove_repeated_lines(docs, ends=True).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash cosine of five-word shingles from 0.8) the row with the smallest
    id stays, null last. Null and wordless texts are one group; rows that repeat are copies."""
    return near_copies.keep_first(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null sources are a source of their own, the last."""
    return mixing.repeat_documents(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and the digest of the decoded text; null counts as empty."""
    coded = pieces.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), piece_model_bytes())
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The language model and XXH64 are outside of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
