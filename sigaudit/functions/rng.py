"""Portable random draws: the first eight hexadecimal digits of an md5, the same on any engine and for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(*parts: Column | str | int) -> Column:
    """A draw from 0 to 2^32 - 1, keyed by the parts joined by colons."""
    keys = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in keys)).cast("binary")), 1, 8), 16, 10).cast("bigint")


def draw(n: Column, *parts: Column | str | int) -> Column:
    """A draw from 0 to n - 1."""
    return bits(*parts) % n
