"""Detection flag, site and contact labels, severity classes and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelight.functions.text import title_words
from tracelight.schemas import (
    FLOOR_SITES, HIGH_TOUCH_LABEL, HIGH_TOUCH_VALUE, LOW_TOUCH_LABEL, ROOM_PREFIX,
    SEVERITY_LEVELS, SUBJECT_PREFIX,
)


def matches(text: Column, pattern: str) -> Column:
    """Regex search that is false, not null, for a null text."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def is_detected(quantity: Column) -> Column:
    """True unless the quantity is null or NaN; never null itself."""
    return quantity.isNotNull() & ~F.coalesce(F.isnan(quantity), F.lit(False))


def is_floor(descriptor: Column) -> Column:
    return matches(descriptor, FLOOR_SITES)


def site_category(descriptor: Column) -> Column:
    """``Floor`` or ``Elevated``; a null descriptor is elevated."""
    return title_words(F.when(is_floor(descriptor), "floor").otherwise("elevated"))


def is_high_touch(touch: Column) -> Column:
    return touch == F.lit(HIGH_TOUCH_VALUE)


def contact_label(flag: Column) -> Column:
    """High/low label of a boolean; null stays null."""
    return F.when(flag, HIGH_TOUCH_LABEL).when(~flag, LOW_TOUCH_LABEL)


def severity_class(
    ventilated: Column, high_flow: Column, positive_pressure: Column, oxygen: Column
) -> Column:
    """Highest level of oxygen support from four three-valued flags.

    The first branch that is certainly true decides; a row whose flags are too
    unknown for every branch stays null.
    """
    strong_absent = ~ventilated & ~high_flow & ~positive_pressure
    none, mid, significant = SEVERITY_LEVELS
    return (
        F.when(strong_absent & ~oxygen, none)
        .when(strong_absent & oxygen, mid)
        .when(ventilated | high_flow | positive_pressure, significant)
    )


def severity_rank(severity: Column, levels: list[str] = SEVERITY_LEVELS) -> Column:
    """Position of a class in its level order, starting at 1."""
    rank = F.when(severity == levels[0], 1)
    for position, level in enumerate(levels[1:], start=2):
        rank = rank.when(severity == level, position)
    return rank


def subject_key(number: Column) -> Column:
    """Text key of a numeric subject id; null stays null."""
    return F.concat(F.lit(SUBJECT_PREFIX), number.cast("bigint").cast("string"))


def room_key(number: Column, width: int = 3) -> Column:
    """Zero-padded room key; a number longer than ``width`` is kept whole."""
    digits = number.cast("bigint").cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
    return F.concat(F.lit(ROOM_PREFIX), padded)
