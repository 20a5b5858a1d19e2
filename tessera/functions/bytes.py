"""Fixed-layout rows: columns at byte offsets of a binary value, big-endian."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """`size` bytes from `offset` on; unsigned unless it has eight bytes."""

    name: str
    offset: int
    size: int


def unsigned(data: Column, offset: int, size: int) -> Column:
    """Four bytes at most, as a long."""
    return F.conv(F.hex(F.substring(data, offset + 1, size)), 16, 10).cast("long")


def signed(data: Column, offset: int) -> Column:
    """Eight bytes, two's complement."""
    high, low = unsigned(data, offset, 4), unsigned(data, offset + 4, 4)
    return F.shiftleft(high, 32).bitwiseOR(low)


def field(data: Column, f: Field) -> Column:
    return signed(data, f.offset) if f.size == 8 else unsigned(data, f.offset, f.size)


def decoded(df: DataFrame, data: str, fields: list[Field]) -> DataFrame:
    """`df` with a column for each field; rows too short for the fields are dropped."""
    width = max((f.offset + f.size for f in fields), default=0)
    whole = df.where(F.octet_length(data) >= width)
    return whole.withColumns({f.name: field(F.col(data), f) for f in fields})


def big_endian(value: Column, size: int) -> Column:
    return F.unhex(F.right(F.lpad(F.hex(value), 16, "0"), F.lit(2 * size)))
