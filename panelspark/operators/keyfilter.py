"""A filter of fixed size over 64-bit keys, tested while rows are read.

The bits are gathered with ``bit_or`` and become one binary literal of ``BYTES`` bytes, whatever the
number of keys.  A key of the set always passes; with more keys more others pass too, so the filter
saves an exchange and never decides a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BYTES = 1 << 17
# Bits used per byte: such bytes are one ASCII character each, which ``ascii`` turns into a number.
BITS = 7


def _places(key: Column) -> tuple[Column, Column]:
    """Byte (from 0) and bit of a key."""
    place = F.pmod(key, F.lit(BYTES * BITS)).cast("int")
    return F.floor(place / BITS).cast("int"), place % BITS


def key_filter(keys: DataFrame, key: str) -> Column:
    """The filter of a column of longs as a binary literal; nulls are left out."""
    byte, bit = _places(F.col(key))
    rows = (keys.filter(F.col(key).isNotNull())
            .select(byte.alias("byte"), F.call_function("shiftleft", F.lit(1), bit).alias("bits"))
            .groupBy("byte").agg(F.bit_or("bits").alias("bits")))
    filled = bytearray(BYTES)
    for row in rows.toLocalIterator():  # at most BYTES rows of two numbers
        filled[row.byte] = row.bits
    return F.lit(filled)


def may_hold(bits: Column, key: Column) -> Column:
    """Whether the filter may hold the key: always for its own keys, rarely for others."""
    byte, bit = _places(key)
    held = F.ascii(F.substring(bits, byte + 1, F.lit(1)).cast("string"))
    return F.getbit(held, bit) == 1
