"""The registered queries opN_<name> of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    binary_topk,
    bit_planes,
    byte_bpe,
    chosen_path,
    filter_audit,
    html_text,
    licence_scan,
    quality_rules,
    source_mix,
    suffix_dedup,
    token_counts,
    token_links,
    warc,
)
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_binary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    return binary_topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(archive).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(table(spark, sf_dir, "documents"))


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.align(table(spark, sf_dir, "documents"))


def op13_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_planes.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mix": op2_source_mix,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_binary_topk": op5_binary_topk,
    "op6_warc": op6_warc,
    "op7_html_text": op7_html_text,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_licence_scan": op9_licence_scan,
    "op10_chosen_path": op10_chosen_path,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_links": op12_token_links,
    "op13_bit_planes": op13_bit_planes,
}

ORACLES = {
    "op5_binary_topk": binary_topk.oracle_sql(),
    "op9_licence_scan": licence_scan.oracle_sql(),
    "op11_filter_audit": filter_audit.oracle_sql(),
}
