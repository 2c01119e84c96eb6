"""The queries of the document operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, language, packing, quality, repetition, secrets, sharding, simhash, warc
from .common import read_table
from .oracles import ORACLES


def op1_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(read_table(spark, sf_dir, "documents")).drop("longest_repeat")


def op2_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op4_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op5_language_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op6_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)


def op8_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read_table(spark, sf_dir, "documents"))


def op9_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read_table(spark, sf_dir, "pages"))


def op10_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repetition_rules,
        op2_simhash_vptree,
        op3_warc_salvage,
        op4_lexical_packing,
        op5_language_bayes,
        op6_latent_leaks,
        op7_rendezvous_shards,
        op8_trigram_secrets,
        op9_wrapper_extraction,
        op10_fourier_quality,
    )
}

__all__ = ["ORACLES", "QUERIES"]
