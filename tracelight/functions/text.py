"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_words(text: Column) -> Column:
    """Underscores to spaces, then title case."""
    return F.initcap(F.regexp_replace(text, "_", " "))


def strip_digits(text: Column, digits: str = "1|2") -> Column:
    """Remove the replicate digits of a site name."""
    return F.regexp_replace(text, digits, "")


def extract_word(text: Column, pattern: str) -> Column:
    """First match of ``pattern``, null (not empty) where there is none."""
    return F.nullif(F.regexp_extract(text, f"({pattern})", 1), F.lit(""))


def spread_text(median: Column, low: Column, high: Column) -> Column:
    """``median (low - high)``."""
    return F.concat(median, F.lit(" ("), low, F.lit(" - "), high, F.lit(")"))
