"""Queries of the ten training-data operators, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, minhash, mixing, ranking, rules, secrets, suffix_tree, urls, warc, weighted_sampling
from .shared import table


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivative_report(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    codec = bpe.BytePairEncoding(spark, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    return bpe.token_digests(table(spark, sf_dir, "documents"), codec)


def op3_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_corpus(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprint_report(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_report(table(spark, sf_dir, "documents"))


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return ranking.score_texts(documents, ranking.train(documents, table(spark, sf_dir, "labels")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("llr")


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_derivatives, op2_byte_bpe, op3_suffix_tree_scores, op4_minhash_near_dedup, op5_weighted_fingerprints,
        op6_secret_scan, op7_quality_rules, op8_quality_ranking, op9_url_filter, op10_pfair_mixing,
    )
}

#: DuckDB SQL over the same tables, for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op4_minhash_near_dedup": minhash.NEAR_SQL, "op7_quality_rules": rules.REPORT_SQL}
