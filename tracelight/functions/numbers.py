"""Numeric expressions: rounding, formatting, replacement and even grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log10_abundance(quantity: Column) -> Column:
    return F.log10(quantity)


def null_to_zero(quantity: Column) -> Column:
    """Undetected quantities as zero (NaN counts as undetected)."""
    return F.coalesce(F.nanvl(quantity, F.lit(None).cast("double")), F.lit(0.0))


def replace_where(value: Column, condition: Column, replacement: Column) -> Column:
    """Replace where the condition is certainly true."""
    return F.when(condition, replacement).otherwise(value)


def significant(value: Column, digits: int) -> Column:
    """Round to significant digits; zero stays zero."""
    value = value.cast("double")
    exponent = F.floor(F.log10(F.abs(value))) - (digits - 1)
    scale = F.pow(F.lit(10.0), exponent.cast("double"))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value / scale) * scale)


def round_half_even(value: Column, digits: int = 1) -> Column:
    return F.bround(value, digits)


def tidy_number(value: Column) -> Column:
    """Shortest text of a number: ``2.0`` prints as ``2``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def percent_text(share: Column, decimals: int = 1) -> Column:
    return F.when(share.isNotNull(), F.format_string(f"%.{decimals}f%%", share * 100.0))


def even_grid(low: Column, high: Column, points: int) -> Column:
    """Array of ``points`` evenly spaced values from ``low`` to ``high``."""
    if points == 1:
        return F.array(low.cast("double"))
    step = (high - low) / F.lit(float(points - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + i * step)
