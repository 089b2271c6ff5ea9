"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import contamination, jaccard, langid, lattice, licenses, media, pieces, sharding, suffixes, warc
from marlstone.session import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.drill(table(spark, sf_dir, "pages"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.digest(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_sharding, op3_licenses, op4_jaccard, op5_langid, op6_pieces, op7_decontamination, op8_warc, op9_lattice, op10_media)}


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": warc.DRILL_SQL}
