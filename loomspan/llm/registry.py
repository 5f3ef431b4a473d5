"""The queries of the training-data operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import centroid_sql
from .common import sized
from .embedding_dedup import VECTOR_SQL
from .hard_negatives import NEGATIVE_SQL
from .line_dedup import LINE_SQL
from .mixing import MIX_SQL
from .quality import quality_sql
from .substring_dedup import WINDOW_SQL
from .url_filter import URL_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    docs = table(spark, sf_dir, "documents")
    judged = sized(quality_rules(docs, ["doc_id"]), docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    docs = table(spark, sf_dir, "documents")
    return sized(mix_sources(docs), docs).select("doc_id", "source", "copy", "copies", "shuffle_key", "text")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import RULES, filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), RULES, carry=["page_id"])


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import html_text

    return html_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files
    from .tokens import tokenizer_path

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    docs = table(spark, sf_dir, "documents")
    done = sized(line_dedup(docs, carry=["doc_id", "text"]), docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    docs = table(spark, sf_dir, "documents")
    done = sized(substring_dedup(docs, carry=["doc_id"]), docs)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import tokenizer_path

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"))
    return hard_negatives(vectors, F.expr("vec_id % 100 = 0"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import centroid_clusters

    return centroid_clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_digests
    from .tokens import tokenizer_path

    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_url_filter": op2_url_filter,
    "op3_html_text": op3_html_text,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_token_files": op5_token_files,
    "op6_line_dedup": op6_line_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash": op8_simhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_pack": op10_pack,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_centroids": op12_centroids,
    "op13_bpe": op13_bpe,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": MIX_SQL,
    "op2_url_filter": URL_SQL,
    "op4_embedding_dedup": VECTOR_SQL,
    "op6_line_dedup": LINE_SQL,
    "op7_substring_dedup": WINDOW_SQL,
    "op9_quality_rules": quality_sql(),
    "op11_hard_negatives": NEGATIVE_SQL,
    "op12_centroids": centroid_sql(),
}
