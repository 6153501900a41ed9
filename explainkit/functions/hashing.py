"""The 64-bit finaliser that orders random ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers and shifts of the finaliser.
FACTORS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SHIFTS = (30, 27, 31)


def _times(c: Column, factor: int) -> Column:
    """Product modulo 2^64 by 32-bit halves; wide sums stay inside a decimal(38)."""
    low, high = c.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), F.shiftrightunsigned(c, 32)
    wide = lambda x: x.cast("decimal(20,0)")
    f_low, f_high = factor & 0xFFFFFFFF, factor >> 32
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    mod = number(2**64)
    first = wide(low) * F.lit(str(f_low)).cast("decimal(10,0)")
    cross = ((wide(low) * F.lit(str(f_high)).cast("decimal(10,0)") + wide(high) * F.lit(str(f_low)).cast("decimal(10,0)")) % F.lit(str(2**32)).cast("decimal(10,0)")) * F.lit(str(2**32)).cast("decimal(10,0)")
    total = (first + cross) % mod
    return F.when(total >= number(2**63), total - mod).otherwise(total).cast("bigint")


def stable_hash64(c: Column, seed: int = 0) -> Column:
    """The hash's bits as a signed long."""
    z = c.cast("bigint") + F.lit(seed).cast("bigint")
    z = z.bitwiseXOR(F.shiftrightunsigned(z, SHIFTS[0]))
    z = _times(z, FACTORS[0])
    z = z.bitwiseXOR(F.shiftrightunsigned(z, SHIFTS[1]))
    z = _times(z, FACTORS[1])
    return z.bitwiseXOR(F.shiftrightunsigned(z, SHIFTS[2]))


def unsigned_order(c: Column) -> Column:
    """A long that sorts as the unsigned value does."""
    return c.bitwiseXOR(F.lit(-(2**63)))


def hash52(*parts: Column | str | int) -> Column:
    """52 bits of the md5 of the parts' texts joined by commas: draws that any SQL engine can repeat."""
    columns = [F.lit(x) if isinstance(x, int) else x for x in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(",", *columns).cast("binary")), 1, 13), 16, 10).cast("bigint")
