"""Log positions and segment names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT, PAGE, ALIGN = 16 << 20, 8192, 8


def text(lsn: Column) -> Column:
    """High and low half in hexadecimal: 00000001/0000002A."""
    half = lambda x: F.lpad(F.hex(x), 8, "0")
    return F.concat(half(F.shiftrightunsigned(lsn, 32)), F.lit("/"), half(lsn.bitwiseAND(F.lit(0xFFFFFFFF))))


def parsed(x: Column) -> Column:
    """The position that `text` shows; halves may lack leading zeros."""
    part = lambda k: F.conv(F.split_part(x, F.lit("/"), F.lit(k)), 16, 10).cast("long")
    return F.shiftleft(part(1), 32).bitwiseOR(part(2))


def segment(lsn: Column, size: int = SEGMENT) -> Column:
    return F.floor(lsn / F.lit(size)) if size & (size - 1) else F.shiftrightunsigned(lsn, size.bit_length() - 1)


def segment_offset(lsn: Column, size: int = SEGMENT) -> Column:
    return lsn % size


def aligned(n: Column) -> Column:
    return F.expr("0L") + (n + (ALIGN - 1)) - (n + (ALIGN - 1)) % ALIGN


def segment_file(lsn: Column, timeline: int = 1, size: int = SEGMENT) -> Column:
    """Timeline, then the segment's number over and within one high half."""
    per, number = (1 << 32) // size, segment(lsn, size)
    parts = [F.lit(timeline).cast("long"), F.floor(number / per), number % per]
    return F.concat(*(F.lpad(F.hex(p.cast("long")), 8, "0") for p in parts))


def segment_name(number: int, timeline: int = 1, size: int = SEGMENT) -> str:
    per = (1 << 32) // size
    return f"{timeline:08X}{number // per:08X}{number % per:08X}"
