"""The training-data pipeline over `documents`: STAGES in order, each reading what the one before wrote as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenstack.llm import ngram_join, packing, pii, quality_rules, suffix_dedup
from lumenstack.llm._common import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that an earlier document or place has are cut out; a document left without a character goes."""
    return suffix_dedup.remove_repeats(docs).filter("text is null or text <> ''")


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by keyed pseudonyms of the same format."""
    return pii.pseudonymise(docs, pii.session_key(spark), found=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", keep_good), ("ngram_join", keep_one), ("suffix_dedup", cut_repeats), ("pii", hide_personal), ("packing", pack)]

#: SQL cannot express the later stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
