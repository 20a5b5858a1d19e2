"""Summarises a folder of log segments: python -m tessera FOLDER [--start LSN] [--end LSN]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import replay
from tessera.session import session
from tessera.sources import wal


def position(text: str) -> int:
    """A position as a number, or as two hexadecimal halves."""
    high, _, low = text.rpartition("/")
    return int(high, 16) << 32 | int(low, 16) if high else int(low)


def segment_size(spark: SparkSession, folder: str) -> int:
    """The one size that all segment files have."""
    files = spark.read.format("binaryFile").load(folder).where(F.element_at(F.split("path", "/"), -1).rlike("^[0-9A-F]{24}$"))
    sizes = [r.length for r in files.select("length").distinct().limit(2).collect()]
    if len(sizes) != 1:
        raise wal.LogError(f"segments of the sizes {sizes} in {folder}")
    return sizes[0]


def summarised(spark: SparkSession, folder: str, timeline: int = 1, start: int = 0, end: int | None = None) -> DataFrame:
    records = wal.read_log(spark, folder, timeline, start, end, segment_size(spark, folder))
    return replay.summary(records).orderBy("rmgr")


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("--timeline", type=int, default=1)
    parser.add_argument("--start", type=position, default=0)
    parser.add_argument("--end", type=position)
    parser.add_argument("--master", default="local[*]")
    o = parser.parse_args(arguments)
    summarised(session(o.master), o.folder, o.timeline, o.start, o.end).show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
