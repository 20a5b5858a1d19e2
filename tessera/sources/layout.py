"""Clustered files in place of an index: sorted ranges whose min/max statistics prune scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_clustered(df: DataFrame, path: str, key: str, files: int, bloom: bool = False) -> None:
    """Range-partitioned and sorted by key, so an equality filter opens few row groups."""
    writer = df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite")
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table whose later joins on key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def file_ranges(df: DataFrame, key: str) -> DataFrame:
    """One row a file: first and last key, rows."""
    named = df.select(F.col(key).alias("key"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    return named.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n_rows"))


def violations(df: DataFrame, key: str) -> DataFrame:
    """What a clustered layout must not have: files that overlap their right neighbour, and rows
    below the one before them in their file. Each task compares the rows of its part of a file as
    they come; only first and last keys are shuffled."""
    # the number of files bounds this window
    order = Window.partitionBy(F.lit(0)).orderBy("low", "high", "file")
    overlap = file_ranges(df, key).withColumn("next_low", F.lead("low").over(order)).where("next_low < high")
    named = df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), F.col(key).alias("key"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, at, keys = batch.column("file"), batch.column("at").to_numpy(), batch.column("key")
            cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    own = keys.slice(a, b - a)
                    wrong = pc.sum(pc.less(own[1:], own[:-1])).as_py() or 0
                    yield pa.RecordBatch.from_arrays([file.slice(a, 1), pa.array([at[a]]), own[:1], own[-1:], pa.array([wrong], pa.int64())], names=["file", "at", "first", "last", "wrong"])

    parts = named.mapInArrow(run, f"file string, at long, first {kind}, last {kind}, wrong long")
    seam = F.lag("last").over(Window.partitionBy("file").orderBy("at"))  # a row a batch
    unsorted = parts.withColumn("n", F.col("wrong") + F.coalesce((F.col("first") < seam).cast("long"), F.lit(0))).where("n > 0")
    rows = unsorted.select("file", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    return overlap.select("file", F.lit("overlap").alias("kind")).unionByName(rows.select("file", F.lit("order").alias("kind")))
