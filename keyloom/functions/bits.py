"""Column functions on bit arrays kept in binary values, the least bit of a byte first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(value: Column, index: Column) -> Column:
    """Unsigned byte at an index from 0; 0 beyond the end."""
    one = F.substring(value, index.cast("int") + 1, F.lit(1))
    return F.coalesce(F.conv(F.nullif(F.hex(one), F.lit("")), 16, 10).cast("long"), F.lit(0).cast("long"))


def get_bit(value: Column, offset: Column | int) -> Column:
    """Bit at an offset, 0 beyond the end or without a value."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return F.getbit(byte_at(value, F.floor(offset / 8)), (offset % 8).cast("int")).cast("int")


def byte_values(value: Column) -> Column:
    """Array of the unsigned bytes of a value."""
    n = F.octet_length(value)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: byte_at(value, i))).otherwise(F.array().cast("array<bigint>"))


def bit_count(value: Column, first: Column | None = None, size: Column | None = None) -> Column:
    """Number of set bits, of a byte range where one is given."""
    part = value if first is None else F.substring(value, (first + 1).cast("int"), size.cast("int"))
    return F.coalesce(F.aggregate(byte_values(part), F.lit(0).cast("long"), lambda a, b: a + F.bit_count(b)), F.lit(0).cast("long"))


def bit_position(value: Column, bit: int) -> Column:
    """First offset of a bit, -1 where there is none."""
    if bit:
        hit = F.filter(F.transform(byte_values(value), lambda b, i: F.when(b != 0, i.cast("long") * 8 + F.element_at(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(b, k) == 1), 1))), lambda x: x.isNotNull())
    else:
        hit = F.filter(F.transform(byte_values(value), lambda b, i: F.when(b != 255, i.cast("long") * 8 + F.element_at(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(b, k) == 0), 1))), lambda x: x.isNotNull())
    return F.coalesce(F.get(hit, F.lit(0)), F.lit(-1).cast("long"))
