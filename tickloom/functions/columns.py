"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float | Column, high: float | Column) -> Column:
    """Bound a column; null stays null (``least``/``greatest`` alone would skip it)."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.greatest(low, F.least(value, high)))


def safe_div(top: Column, bottom: Column, otherwise: float | None = None) -> Column:
    value = F.try_divide(top, bottom)
    return value if otherwise is None else F.coalesce(value, F.lit(otherwise))


def ratio(top: Column, bottom: Column) -> Column:
    """Division as floating point defines it: by zero it is infinite with the signs of ``top`` and of the zero, and NaN for zero by zero."""
    return F.when(bottom == 0, top.cast("double") * F.pow(bottom, F.lit(-1.0))).otherwise(F.try_divide(top, bottom))


def rounded(value: Column, digits: int = 6) -> Column:
    """Report rounding that never yields a negative zero.

    The scaled value is rounded half away from zero and scaled back, as SQL engines do with doubles: a number too large for so many
    decimals may thereby move to a neighbour, which the rounding of its decimal form would not show.
    """
    scale = 10.0 ** digits
    near = F.round(value * scale) / scale
    return F.when(F.abs(value) < 0.5 / scale, 0.0).when(F.abs(near) < float("inf"), near).otherwise(value)


def single(value: Column) -> Column:
    """Single precision without negative zero."""
    return F.when(F.abs(value) < 5e-10, 0.0).otherwise(value.cast("float").cast("double"))


def fixed(x: Column, digits: int, sign: str = "") -> Column:
    """Text of a moderate ``x`` with so many decimals (``sign`` "+": always signed); a value beside a half unit is rounded by its exact
    binary value, as ``%.2f`` does in most languages, where Java's formatter rounds its shortest decimal form up."""
    unit = 10 ** digits
    size = F.abs(x)
    halves = F.rint(size * (2 * unit))
    # Products with powers of two are exact, and so are the differences near zero.
    gap = halves
    for power in reversed(range((2 * unit).bit_length())):
        if 2 * unit >> power & 1:
            gap = gap - size * 2 ** power
    odd = (halves.cast("long") % 2) != 0
    down = F.floor(halves / 2)
    units = F.when(gap > 0, down).when(gap < 0, down + 1).otherwise(F.when(down % 2 == 0, down).otherwise(down + 1))
    near = F.when(x < 0, -(units / unit)).otherwise(units / unit)
    return F.format_string(f"%{sign}.{digits}f", F.when(odd, near).otherwise(x))


def two_decimals(x: Column) -> Column:
    return fixed(x, 2)
