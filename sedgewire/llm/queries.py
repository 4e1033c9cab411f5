"""The thin queries of the contract: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.llm import byte_bpe, html_extraction, language_id, lexical_search, line_dedup, mixing, pii, resampling, toxicity
from sedgewire.llm.common import dealt_out, read_table
from sedgewire.llm.embedding_groups import embedding_groups
from sedgewire.llm.near_duplicates import near_duplicate_groups
from sedgewire.llm.repeated_spans import remove_repeats
from sedgewire.llm.transport_stream import media_digests


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(dealt_out(read_table(spark, sf_dir, "documents")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_texts(dealt_out(read_table(spark, sf_dir, "pages")))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(read_table(spark, sf_dir, "documents"), k=3, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.remove_boilerplate(read_table(spark, sf_dir, "documents"), min_sites=8)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("text_kept", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = toxicity.fit_on(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), net, "score")
    return scored.select("doc_id", (toxicity.crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.token_digests(dealt_out(read_table(spark, sf_dir, "documents")), path, public_tokenizers.PATTERN)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    told = language_id.identify(docs.select("doc_id", "text"), language_id.fit_on(docs))
    return told.select("doc_id", language_id.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(dealt_out(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"), k=20)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(dealt_out(read_table(spark, sf_dir, "documents")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt_out(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    drawn = resampling.resample(docs, read_table(spark, sf_dir, "benchmark"), percent=5)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_media_columns": op3_media_columns,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_pii": op12_pii,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
}
