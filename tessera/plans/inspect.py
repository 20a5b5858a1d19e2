"""What a plan does, as text and facts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def joins(df: DataFrame) -> list[str]:
    """Names of the join operators, outermost first."""
    return re.findall(r"(BroadcastHashJoin|ShuffledHashJoin|SortMergeJoin|BroadcastNestedLoopJoin|CartesianProduct)", physical(df))


def exchanges(df: DataFrame) -> int:
    return len(re.findall(r"(?<!Broadcast)Exchange ", physical(df)))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", physical(df))


def read_columns(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", physical(df))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """`df` with a count of the rows that pass here, known after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
