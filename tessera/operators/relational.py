"""Scans, filters, projections, joins, aggregates and order as thin DataFrame builders.

The caller gives columns and conditions; Catalyst chooses pushdown, pruning and join plans. A hint
is only set where a strategy is asked for by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest measured side, in bytes, that `broadcast_join` sends to all executors.
BROADCAST_BYTES = 64 << 20
STRATEGIES = {"hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl", "auto": None}


def select_where(df: DataFrame, condition: Column | str, *columns: Column | str) -> DataFrame:
    out = df.where(condition)
    return out.select(*columns) if columns else out


def project(df: DataFrame, *columns: Column | str, drop: Column | None = None) -> DataFrame:
    """Columns of each row; rows for which `drop` holds have no result."""
    return (df if drop is None else df.where(~F.coalesce(drop, F.lit(False)))).select(*columns)


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """All rows with this key: an equality that reaches the scan's statistics."""
    return df.where(F.col(key) == F.lit(value))


def join(outer: DataFrame, inner: DataFrame, on: Column | str | list[str], strategy: str = "auto") -> DataFrame:
    """Inner join by an equality, with the plan named by `strategy`."""
    hint = STRATEGIES[strategy]
    return outer.join(inner.hint(hint) if hint else inner, on, "inner")


def theta_join(outer: DataFrame, inner: DataFrame, condition: Column) -> DataFrame:
    """Inner join by any condition. Its work is the product of both sides, so the smaller one should
    be a bounded table; Spark broadcasts it if its statistics allow and else replicates blocks."""
    return outer.join(inner, condition, "inner")


def measured_bytes(df: DataFrame) -> int:
    """The optimizer's size of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_join(outer: DataFrame, inner: DataFrame, on: Column | str | list[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcasts the inner side if its size is known to be small, else joins by shuffle."""
    return outer.join(F.broadcast(inner) if measured_bytes(inner) <= limit else inner, on, "inner")


def combined(joined: DataFrame, *columns: Column | str, drop: Column | None = None) -> DataFrame:
    return project(joined, *columns, drop=drop)


def group(df: DataFrame, keys: list[str] | list[Column], *aggregates: Column) -> DataFrame:
    """One row a group; no group on empty input, also for a constant key."""
    return df.groupBy(*(keys or [F.lit(0).alias("all")])).agg(*aggregates)


def in_first_seen_order(df: DataFrame, keys: list[str], position: Column, *aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates, F.min(position).alias("__first")).orderBy("__first").drop("__first")


def wrapped(value: Column) -> Column:
    """A whole decimal number as 64 bits, by wrapping."""
    half, whole = F.lit("9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")
    return (F.pmod(value.cast("decimal(38,0)") + half, whole) - half).cast("long")


def wrapped_product(a: Column, b: Column) -> Column:
    """A 64-bit product of two 64-bit numbers that wraps instead of raising."""
    return wrapped(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"))


def wrapped_sum(value: Column) -> Column:
    """A 64-bit sum that wraps instead of raising."""
    return wrapped(F.sum(value.cast("decimal(19,0)")))


def ordered(df: DataFrame, *keys: Column | str, ties: list[Column | str]) -> DataFrame:
    """A total order: `ties` makes equal keys come out the same on every run."""
    return df.orderBy(*keys, *ties)


def limited(df: DataFrame, n: int) -> DataFrame:
    """The first n rows; all of them if n is not positive."""
    return df.limit(n) if n > 0 else df


def top(df: DataFrame, n: int, *keys: Column | str, ties: list[Column | str]) -> DataFrame:
    """Order and limit in one: each task keeps its best n only."""
    return limited(ordered(df, *keys, ties=ties), n)


def custom_aggregate(function: Callable, returns: str, *columns: str) -> Column:
    """A user's aggregate over whole groups, given as a function from pandas series to a scalar, with
    type hints that say so. Built-in
    functions aggregate before the shuffle; this one can't, so groups must fit a task."""
    return F.pandas_udf(function, returns)(*columns)
