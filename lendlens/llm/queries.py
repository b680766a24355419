"""A query for each operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lendlens.llm import divergence, exact_dedup, extraction, kneser_ney, llr_rules, pareto_mix, partenum, piece_transducer, quality_qda, suffix_merge, superkmers, warc, whitening
from lendlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.report(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.report(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.report(table(spark, sf_dir, "documents"))


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix(table(spark, sf_dir, "documents"))


def op6_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.report(table(spark, sf_dir, "documents"))


def op7_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.encode_documents(table(spark, sf_dir, "documents"))


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_merge.report(table(spark, sf_dir, "documents"))


def op10_llr_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return llr_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.report(table(spark, sf_dir, "pages"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_partenum": op2_partenum,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_pareto_mix": op5_pareto_mix,
    "op6_superkmers": op6_superkmers,
    "op7_piece_transducer": op7_piece_transducer,
    "op8_quality_qda": op8_quality_qda,
    "op9_suffix_merge": op9_suffix_merge,
    "op10_llr_rules": op10_llr_rules,
    "op11_extraction": op11_extraction,
    "op12_divergence": op12_divergence,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op2_partenum": partenum.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_superkmers": superkmers.ORACLE,
    "op9_suffix_merge": suffix_merge.ORACLE,
    "op12_divergence": divergence.ORACLE,
}
