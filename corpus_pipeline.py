"""A corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, mixing, pii, quality, simhash
from tessera.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or exceed a fence of their language and source go."""
    return quality.filtered(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, give way to the names of their kinds."""
    return pii.sanitised(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's text becomes the words that the mix takes of it."""
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents."""
    return bpe.round_trip(docs, bpe.default_path())


STAGES: list[tuple[str, Stage]] = [("quality", quality_stage), ("simhash", simhash_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: SQL has no SimHash over whole texts and no BPE, so there is no SQL for these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
