"""The queries of this subpackage: ``opN_<name>`` for each operator, with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, common, gru_lm, language_crf, line_dedup, mixing, packing, pq_dedup, prefix_trie, quality_qda, quality_rules, substring_dedup, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_pages(table(spark, sf_dir, "pages"))


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_gru_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(table(spark, sf_dir, "documents"))


def op11_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.classify(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_beginnings(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


_ALL = (op1_quality_classifier, op2_substring_dedup, op3_source_mixing, op4_line_dedup, op5_retrieval_packing, op6_warc, op7_bagminhash, op8_quality_rules, op9_embedding_dedup, op10_gru_language_model, op11_language_crf, op12_prefix_trie, op13_whitening)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": line_dedup.ORACLE, "op6_warc": warc.ORACLE, "op9_embedding_dedup": pq_dedup.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE}
