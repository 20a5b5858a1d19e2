"""Parquet tables and working folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; filters and column choice reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share; temporary only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
