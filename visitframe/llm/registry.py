"""The registered queries of the numbered operators and the DuckDB SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.llm import crf_language, e8_neighbors, ftrl_toxicity, hash_tree, html_density, kneser_ney, line_dedup, lyndon_runs, mixing, pieces, prefix_trie, simhash, telephony


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def piece_model_bytes(name: str = "piece_bpe_32k.model") -> bytes:
    """Content of a public vocabulary file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.op1_kneser_ney(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_and_decode(_documents(spark, sf_dir).select("doc_id", "text"), piece_model_bytes())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_density.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op4_simhash(_documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5_mixing(_documents(spark, sf_dir))


def op6_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.op6_hash_tree(_documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op7_line_dedup(_documents(spark, sf_dir))


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = telephony.to_media(_documents(spark, sf_dir))
    return telephony.decode_media(media).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_language.op9_language_id(_documents(spark, sf_dir))


def op10_e8_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e8_neighbors.op10_e8_neighbors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyndon_runs.op11_periodic_runs(_documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op12_prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl_toxicity.op13_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kneser_ney": op1_kneser_ney,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_html": op3_html,
        "op4_simhash": op4_simhash,
        "op5_mixing": op5_mixing,
        "op6_hash_tree": op6_hash_tree,
        "op7_line_dedup": op7_line_dedup,
        "op8_telephony": op8_telephony,
        "op9_language_id": op9_language_id,
        "op10_e8_neighbors": op10_e8_neighbors,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mixing": mixing.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE,
        "op10_e8_neighbors": e8_neighbors.ORACLE,
        "op12_prefix_trie": prefix_trie.ORACLE,
    }
