"""Exact sums and engine-independent rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW_BITS = 20
_LARGEST = 9e14
_WHOLE = float(1 << 52)  # doubles from here on have no digits after the point


def exact_sum(c: Column | str) -> Column:
    """Sum of amounts to four digits, the same whatever the order in which partitions are merged.

    Amounts are whole numbers of 1/10000 (halves away from zero) cut into a high and a low part, whose sums are
    plain longs: as fast as a sum of doubles, without rounding, and without overflow up to 10^12 rows. Amounts
    that do not fit a long that way are summed as decimals beside them.
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    fits = F.abs(x) < F.lit(_LARGEST)
    size = F.floor(F.when(fits, F.abs(x)) * F.lit(1e4) + F.lit(0.5))
    units = F.when(x < 0, -size).otherwise(size)
    rest = F.sum(F.when(~fits, x.cast("decimal(38,4)")))
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(24,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(19,0)")
    whole = high * F.lit(1 << _LOW_BITS).cast("decimal(7,0)") + low
    small = (whole * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(38,4)")
    return F.when(rest.isNull(), small).otherwise((F.coalesce(small, F.lit(0).cast("decimal(38,4)")) + rest).cast("decimal(38,4)"))


def rounded(c: Column, digits: int) -> Column:
    """Half away from zero on doubles; adding 0 turns a negative zero into zero. Values without digits to round,
    infinities among them, stay as they are."""
    scale = float(10 ** digits)
    x = c.cast("double")
    small = F.abs(x) * F.lit(scale) < F.lit(_WHOLE)
    return F.when(x.isNull() | small, F.signum(x) * F.floor(F.when(small, F.abs(x)) * F.lit(scale) + F.lit(0.5)) / F.lit(scale) + F.lit(0.0)).otherwise(x)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division with NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    return rounded(F.try_divide(numerator.cast("double") * F.lit(100.0), denominator.cast("double")), digits)


def weighted_sum(value: Column, weight: Column) -> Column:
    """Exact sum of value x weight, with eight digits of the value."""
    return F.sum(value.cast("decimal(18,8)") * weight.cast("decimal(12,0)"))


def nearest_units(c: Column, digits: int) -> Column:
    """A double as a decimal with so many digits: scaled as a double first, as SQL engines do, then halves away from zero."""
    units = F.round(c * F.lit(float(10 ** digits))).cast("decimal(18,0)")
    return (units * F.lit(f"{10 ** -digits:.{digits}f}").cast(f"decimal({digits + 1},{digits})")).cast(f"decimal(18,{digits})")


def json_number(c: Column) -> Column:
    """A finite double as JSON text: plain digits from 1e-6 up to 1e21, an exponent elsewhere, and null."""
    size = F.abs(c)

    def plain(digits: int) -> Column:
        return F.regexp_replace(c.cast(f"decimal(38,{digits})").cast("string"), r"(\.\d+?)0+$", "$1")

    text = c.cast("string")
    short = F.regexp_replace(F.lower(text), r"\.0e", "e")
    return F.coalesce(
        F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), text)
        .when((size >= 1e-6) & (size < 1e-3), plain(30)).when((size >= 1e7) & (size < 1e21), plain(17))
        .otherwise(short), F.lit("null"))
