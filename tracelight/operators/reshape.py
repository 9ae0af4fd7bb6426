"""Stacking and pivoting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions import extract_word
from tracelight.operators.joins import group_lookup


def stack(tables: dict[str, DataFrame], key: str = "model_name") -> DataFrame:
    """Union of keyed tables."""
    parts = [table.withColumn(key, F.lit(name)) for name, table in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def longer(df: DataFrame, ids: Sequence[str] = (), name: str = "name", value: str = "value") -> DataFrame:
    """All columns but ``ids`` as (name, value) rows."""
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], name, value)


def wider(df: DataFrame, ids: Sequence[str], names: str, values: str, wanted: Sequence[str]) -> DataFrame:
    """One column per wanted value of ``names``; explicit values avoid a first pass."""
    return df.groupBy(*ids).pivot(names, list(wanted)).agg(F.first(values))


def flag_summary(totals: DataFrame) -> DataFrame:
    """Count and proportion per flag from the one wide row of totals."""
    long = longer(totals).select(
        F.regexp_replace("name", "_count|_proportion", "").alias("name"),
        extract_word(F.col("name"), "count|proportion").alias("measure"),
        "value",
    )
    return wider(long, ["name"], "measure", "value", ["count", "proportion"])


def floor_against_touched(curves: DataFrame, swabs: DataFrame, value: str = "epred") -> DataFrame:
    """Per room: floor and elevated value side by side, with the room's first day and unit.

    The unit is that of the earliest sample (lowest site name among ties).
    """
    wide = wider(curves, ["subject_room_id"], "site_category", value, ["Floor", "Elevated"])
    wide = wide.withColumn("numeric_id", F.regexp_replace("subject_room_id", "decon_", ""))
    return group_lookup(
        wide, swabs, ["subject_room_id"],
        {
            "total_study_day": F.min("total_study_day"),
            "subject_room_day": F.min("subject_room_day"),
            "unit": F.min_by("unit", F.struct("total_study_day", "swab_site", "unit")),
        },
    )
