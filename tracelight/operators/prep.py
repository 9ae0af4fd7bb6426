"""Derivation of the analysis table and small projections and filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import (
    contact_label, is_detected, is_high_touch, matches, severity_class, site_category, subject_key,
)
from tracelight.operators.groups import first_samples
from tracelight.operators.joins import subject_attributes
from tracelight.schemas import ANALYSIS_COLUMNS, EXCLUDED_SITES

VARIANTS = {
    "spatial": dict(columns="spatial", first_only=True, text_key=False),
    "spatial_days": dict(columns="spatial_days", first_only=True, text_key=False),
    "longitudinal": dict(columns="longitudinal", first_only=False, text_key=True),
    "longitudinal_days": dict(columns="longitudinal_days", first_only=False, text_key=True),
    "severity": dict(columns="longitudinal_days", first_only=True, text_key=True),
}


def comparable_sites(swabs: DataFrame, excluded: str = EXCLUDED_SITES) -> DataFrame:
    """Drop sites outside the common distance scheme; a null site is kept."""
    return swabs.where(~matches(F.col("site_descriptor"), excluded))


def with_site_flags(swabs: DataFrame) -> DataFrame:
    return swabs.withColumns(
        {
            "scv2_detected": is_detected(F.col("copies_max")),
            "site_category": site_category(F.col("site_descriptor")),
            "high_touch": is_high_touch(F.col("touch")),
        }
    )


def select_once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Select, keeping only the first of repeated names."""
    return df.select(*dict.fromkeys(columns))


def drop_matching(df: DataFrame, part: str) -> DataFrame:
    """Drop the columns whose name contains ``part``."""
    return df.drop(*[c for c in df.columns if part in c])


def keep_first(df: DataFrame, part: str) -> DataFrame:
    """Columns whose name contains ``part`` first, then all others."""
    chosen = [c for c in df.columns if part in c]
    return select_once(df, chosen + df.columns)


def with_subject_key(df: DataFrame, column: str = "redcap_id") -> DataFrame:
    return df.withColumn(column, subject_key(F.col(column)))


def with_severity(subjects: DataFrame) -> DataFrame:
    return subjects.withColumn(
        "covid_severity",
        severity_class(
            F.col("mech_vent_ever"), F.col("high_flow_nc_ever"),
            F.col("bipap_cpap_ever"), F.col("supp_oxy_ever"),
        ),
    )


def analysis_table(swabs: DataFrame, variant: str, subjects: DataFrame | None = None) -> DataFrame:
    """Analysis table of one variant.

    Duplicates are removed after the projection, so the columns of the variant
    decide how many rows are left; optimisers may not move that projection.
    """
    spec = VARIANTS[variant]
    rows = first_samples(swabs) if spec["first_only"] else swabs
    table = with_site_flags(comparable_sites(rows))
    table = select_once(table, ANALYSIS_COLUMNS[spec["columns"]])
    if spec["text_key"]:
        table = with_subject_key(table)
    table = table.distinct()
    if variant == "severity":
        if subjects is None:
            raise ValueError("the severity variant needs the subjects table")
        table = subject_attributes(table, with_severity(subjects), ["covid_severity"])
    return table


def possible_cells(grid: DataFrame) -> DataFrame:
    """Drop the cell that no surface can have: a floor under frequent touch."""
    impossible = F.col("high_touch") & (F.col("site_category") == "Floor")
    return grid.where(~F.coalesce(impossible, F.lit(False)))


def touched_or_floor(df: DataFrame) -> DataFrame:
    """High-touch elevated surfaces and all floors."""
    elevated = (F.col("site_category") == "Elevated") & F.col("high_touch")
    return df.where(elevated | (F.col("site_category") == "Floor"))


def at_minimum(df: DataFrame, column: str) -> DataFrame:
    """Rows at the overall minimum of ``column``."""
    return df.where(F.col(column) == df.agg(F.min(column)).scalar())


def nearest_to(df: DataFrame, column: str, value: float) -> DataFrame:
    """Rows at the grid point nearest to ``value``; the lower point wins a tie."""
    points = df.agg(F.min(F.struct(F.abs(F.col(column) - value).alias("gap"), F.col(column).alias("point"))).alias("best"))
    return df.where(F.col(column) == points.select("best.point").scalar())


def with_contact_label(df: DataFrame, column: str = "high_touch") -> DataFrame:
    return df.withColumn(column, contact_label(F.col(column)))


def model_frame(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The fitted rows: the used columns without rows that miss any of them."""
    return select_once(table, columns).dropna()


def map_numeric(df: DataFrame, function: Callable[[Column], Column], suffix: str) -> DataFrame:
    """Apply ``function`` to every numeric column into ``<name>_<suffix>``."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    extra = {f"{c}_{suffix}": function(F.col(c)) for c, t in df.dtypes if t in numeric or t.startswith("decimal")}
    return df.withColumns(extra)
