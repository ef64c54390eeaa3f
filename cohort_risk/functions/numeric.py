"""Numeric helpers that keep Spark and the SQL oracle in agreement (ANSI safe
division, half-even rounding, clipping, correlation without divide-by-zero)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(part: Column, whole: Column) -> Column:
    """part / whole * 100; NULL when whole is 0 (ANSI-safe)."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def avg_round(col: Column, digits: int) -> Column:
    """Average rounded half-even to ``digits``. The mean is first fixed to 9
    decimals so that summation-order noise (which differs between engines and
    between partitionings) cannot flip a tie like 3.085 either way; the
    half-even step is then exact decimal arithmetic."""
    return F.bround(F.avg(col).cast("decimal(38,9)"), digits).cast("double")


def clip(col: Column, lo: float | None, hi: float | None) -> Column:
    """``Series.clip``: NULL stays NULL."""
    out = col
    if lo is not None:
        out = F.when(out < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > F.lit(hi), F.lit(hi)).otherwise(out)
    return out


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).cast("bigint")


def fixed_text(x: Column, digits: int) -> Column:
    """Text of a double with ``digits`` decimals, rounded half-even on its exact
    binary value, as Python and C print it (2.675 -> 2.67, 0.125 -> 0.12; for
    magnitudes from 2^-10 to 2^36, or 0). The value is split into two
    exact integers (units of 2^-26 and 2^-62) and rounded in decimals."""
    big = "decimal(38,0)"
    a = F.abs(x.cast("double"))
    high = F.floor(a * float(2**26))
    low = F.floor((a * float(2**26) - high) * float(2**36))
    scaled = ((high.cast(big) * F.lit(2**36).cast(big) + low.cast(big)) * F.lit(10**digits).cast(big)).cast(big)
    unit = F.lit(2**62).cast(big)
    whole = F.floor((scaled / unit).cast("decimal(38,6)")).cast(big)
    whole = F.when(whole * unit > scaled, whole - 1).otherwise(whole).cast(big)  # the quotient was rounded
    twice = (2 * (scaled - whole * unit)).cast(big)
    up = (twice > unit) | ((twice == unit) & (whole % 2 == 1))
    rounded = F.when(up, whole + 1).otherwise(whole).cast("long")
    power = F.lit(10**digits)
    head = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.floor(rounded / power).cast("long").cast("string"))
    return F.concat(head, F.lit("."), F.lpad((rounded % power).cast("string"), digits, "0")) if digits else head
