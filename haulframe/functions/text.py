"""Text, number-label and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulframe.functions.nulls import as_col


def blank_to_null(c: str | Column) -> Column:
    """Empty text and the literal NA are both missing."""
    c = as_col(c)
    return F.when(~F.trim(c).isin("", "NA"), c)


def join_text(sep: str, *cols: str | Column, show_na: bool = False) -> Column:
    """Concatenate; NULL parts are skipped, or written NA when asked for."""
    parts = [as_col(c).cast("string") for c in cols]
    if show_na:
        parts = [F.coalesce(p, F.lit("NA")) for p in parts]
    return F.concat_ws(sep, *parts)


def big_int(c: str | Column) -> Column:
    """Whole number with thousands commas."""
    return F.format_number(as_col(c), 0)


def fixed(c: str | Column, digits: int) -> Column:
    """Number with a fixed count of decimals, without thousands commas."""
    c = as_col(c).cast("double")
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", F.round(c, digits)))


def _halves(x: Column) -> tuple[Column, Column]:
    """Upper and lower part of a double, so that products of parts are exact."""
    wide = x * F.lit(134217729.0)  # 2**27 + 1
    high = wide - (wide - x)
    return high, x - high


def round_stored(c: str | Column, digits: int) -> Column:
    """Round the exact value that the double stores; a true tie goes to the even digit.

    ``round`` works on the shortest decimal that reads as the number: 0.15 to one digit is
    0.2, although the stored value is below 0.15 and rounds to 0.1.  Here the product with
    the power of ten is taken with its rounding error.  Numbers of 2**52 and more after
    scaling stay as they are.
    """
    x = as_col(c).cast("double")
    scale = float(10**digits)
    product = x * F.lit(scale)
    (high, low), split = _halves(x), 134217729.0 * scale
    top = split - (split - scale)
    rest = scale - top
    error = ((high * top - product) + high * rest + low * top) + low * rest
    floor = F.floor(product).cast("double")
    over = (product - floor) - 0.5
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (F.abs(floor) % 2 == 1))))
    rounded = (floor + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)
    small = F.abs(product) < F.lit(2.0**52)
    return F.when(x.isNull(), None).when(~F.isnan(x) & small, rounded).otherwise(x)


def fixed_stored(c: str | Column, digits: int) -> Column:
    """Fixed decimals of the stored value, as ``round_stored`` rounds it."""
    value = round_stored(c, digits)
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))


def to_number(c: str | Column) -> Column:
    """Text to number; unreadable text becomes NULL."""
    return as_col(c).try_cast("double")


def parse_date(c: str | Column, pattern: str = "yyyy/MM/dd") -> Column:
    """Text to date; unreadable text becomes NULL."""
    return F.try_to_timestamp(as_col(c), F.lit(pattern)).cast("date")


def floor_to(c: str | Column, step: float) -> Column:
    """Floor to a multiple of ``step``."""
    return F.floor(as_col(c) / F.lit(step)) * F.lit(step)


def leading_letters(c: str | Column) -> Column:
    """Letter part of a packed code such as F048."""
    part = F.regexp_extract(as_col(c), r"^([A-Z]+)([0-9]+)$", 1)
    return F.when(part != "", part)


def trailing_number(c: str | Column) -> Column:
    """Number part of a packed code such as F048."""
    return to_number(F.regexp_extract(as_col(c), r"^([A-Z]+)([0-9]+)$", 2))


def clock_hours(c: str | Column) -> Column:
    """Hours in a packed HHMM integer (1457 is 14.95 hours)."""
    c = as_col(c)
    return F.floor(c / 100) + (c % 100) / F.lit(60.0)


def cylinder_volume(diameter: str | Column, height: str | Column) -> Column:
    return F.pi() * F.pow(as_col(diameter) / 2, F.lit(2)) * as_col(height)
