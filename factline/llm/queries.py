"""The registered query of every operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factline.llm import decontaminate, html, jaccard, langid, licenses, lm, mixing, quality, secrets, sharding
from factline.ship import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_mixture(_table(spark, sf_dir, "documents"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_score(_table(spark, sf_dir, "documents"))


def op9_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_html(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_jaccard_join, op3_language_mixture, op4_shard, op5_decontaminate, op6_license_scan, op7_mix_sources, op8_lm_score, op9_extract_html, op10_quality_rules)}
ORACLES = {
    "op1_secret_scan": secrets.oracle(),
    "op2_jaccard_join": jaccard.oracle(),
    "op6_license_scan": licenses.oracle(),
    "op7_mix_sources": mixing.oracle(),
    "op10_quality_rules": quality.oracle(),
}
