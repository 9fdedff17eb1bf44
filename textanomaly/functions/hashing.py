"""Seeded order keys; md5 is used because plain SQL engines can repeat it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def order_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by ``|``; sorting by it gives a seeded random order."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]).cast("binary"))


def leading_bits(key: Column) -> Column:
    """The first 60 bits of a hexadecimal key as a long."""
    return F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long")


def magnitude(key: Column) -> Column:
    """Bit length of the leading bits: a geometric histogram over uniform keys."""
    return F.length(F.bin(leading_bits(key)))
