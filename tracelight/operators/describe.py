"""Descriptive aggregates of detection and the surface summary table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import (
    contact_label, is_detected, percent_text, round_half_even, significant, spread_text,
    strip_digits, tidy_number, title_words,
)
from tracelight.operators.joins import distinct_lookup, keyed_join
from tracelight.operators.quantiles import exact_quantiles
from tracelight.schemas import SUBJECT_FLAGS

# The key sets detection is described by.
DETECTION_KEYS = {
    "site": ["swab_site", "site_descriptor"],
    "unit": ["unit"],
    "room": ["subject_room_id"],
    "room_unit": ["subject_room_id", "unit"],
    "room_day": ["subject_room_day", "swab_site"],
    "study_day": ["subject_study_day", "swab_site"],
    "hosp_day": ["subject_hosp_day", "swab_site"],
    "covid_day": ["subject_covid_day", "swab_site"],
}


def share_detected(quantity: str = "copies_max") -> Column:
    return F.avg(is_detected(F.col(quantity)).cast("double"))


def detection_by(df: DataFrame, keys: Sequence[str], quantity: str = "copies_max") -> DataFrame:
    return df.groupBy(*keys).agg(share_detected(quantity).alias("prop_positive"))


def count_distinct_with_null(column: str) -> Column:
    """Distinct values, counting missing as one of them."""
    return F.countDistinct(column) + F.max(F.col(column).isNull().cast("int"))


def surface_table(table: DataFrame, swabs: DataFrame, compat_q75: bool = False) -> DataFrame:
    """Per surface: rooms, specimens, share detected and spread of log10 copies.

    ``compat_q75=True`` prints the median in place of the upper quartile.
    """
    keys = ["site_category", "site_descriptor", "high_touch"]
    rows = distinct_lookup(table, swabs, ["swab_site"], ["site_descriptor"]).select(
        "site_category",
        title_words(strip_digits(F.col("site_descriptor"))).alias("site_descriptor"),
        contact_label(F.col("high_touch")).alias("high_touch"),
        "subject_room_id",
        "copies_max",
        F.log10("copies_max").alias("log_copies"),
    )
    counts = rows.groupBy(*keys).agg(
        count_distinct_with_null("subject_room_id").alias("unique_subjects"),
        F.count(F.lit(1)).alias("unique_specimens"),
        share_detected().alias("prop_positive"),
    )
    spread = exact_quantiles(
        rows, keys, "log_copies", {"med_copies": 0.5, "q25_copies": 0.25, "q75_copies": 0.75}
    )
    joined = keyed_join(counts, spread, keys)
    if compat_q75:
        joined = joined.withColumn("q75_copies", F.col("med_copies"))

    def shown(c: str) -> Column:
        return tidy_number(round_half_even(F.col(c), 1))

    return joined.withColumn(
        "copies_summary", spread_text(shown("med_copies"), shown("q25_copies"), shown("q75_copies"))
    )


def printed_surface_table(summary: DataFrame) -> DataFrame:
    """The surface table as printed: percent text, labels, most detected first."""
    return sort_desc(summary, ["prop_positive"], ["site_category", "site_descriptor"]).select(
        F.col("site_category").alias("Height"),
        F.col("site_descriptor").alias("Location"),
        F.col("high_touch").alias("Contact"),
        F.col("unique_subjects").alias("Subjects Sampled"),
        F.col("unique_specimens").alias("Surfaces Sampled"),
        percent_text(F.col("prop_positive")).alias("Detected"),
        F.col("copies_summary").alias("Median (IQR) log10 Copies"),
    )


def sort_desc(df: DataFrame, columns: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """Descending order with missing values last, then ascending tie-breakers."""
    return df.orderBy(
        *[F.col(c).desc_nulls_last() for c in columns], *[F.col(c).asc_nulls_last() for c in then]
    )


def sort_asc(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ascending order with missing values last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def sort_within(df: DataFrame, section: str, column: str, then: Sequence[str] = ()) -> DataFrame:
    """Sections in order, each sorted by ``column`` descending."""
    return df.orderBy(
        F.col(section).asc_nulls_last(), F.col(column).desc_nulls_last(),
        *[F.col(c).asc_nulls_last() for c in then],
    )


def counts_by(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def share_of_total(counts: DataFrame, count: str = "count", name: str = "percent") -> DataFrame:
    """Percentage of the overall count."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(name, F.col(count) / total * 100.0)


def share_text(percent: Column, digits: int = 3) -> Column:
    return F.concat(tidy_number(significant(percent, digits)), F.lit("%"))


def flag_totals(subjects: DataFrame, flags: Sequence[str] = SUBJECT_FLAGS) -> DataFrame:
    """One wide row: count and proportion of every flag, in a single pass.

    A flag with a missing value has a missing count, as a sum that does not
    skip missing values would.
    """
    columns = []
    for flag in flags:
        total = F.when(F.count_if(F.col(flag).isNull()) == 0, F.sum(F.col(flag).cast("int")))
        columns.append(total.cast("double").alias(f"{flag}_count"))
        columns.append((total / F.count(F.lit(1))).alias(f"{flag}_proportion"))
    return subjects.agg(*columns)


def cohort_counters(table: DataFrame) -> DataFrame:
    """Specimens, rooms, subjects and subjects seen in more than one room."""
    rooms = table.groupBy("redcap_id").agg(
        count_distinct_with_null("subject_room_id").alias("rooms"), F.count(F.lit(1)).alias("rows")
    )
    per_subject = rooms.agg(
        F.sum("rows").alias("specimens"),
        F.count(F.lit(1)).alias("subjects"),
        F.count_if(F.col("rooms") > 1).alias("transferred"),
    )
    rooms_total = table.agg(count_distinct_with_null("subject_room_id")).scalar()
    return per_subject.select("specimens", rooms_total.alias("rooms"), "subjects", "transferred")


def sampling_events(table: DataFrame) -> DataFrame:
    """Mean and standard deviation of sampling days per room, two significant digits."""
    days = table.select("subject_room_id", "subject_room_day").distinct()
    per_room = days.groupBy("subject_room_id").agg(F.count(F.lit(1)).alias("n"))
    return per_room.agg(
        significant(F.avg("n"), 2).alias("mean_events"), significant(F.stddev_samp("n"), 2).alias("sd_events")
    )


def number_summary(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(column).alias("min"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd")
    )
