"""Surveillance views over the given star-schema tables.

Each event is a swab and each customer a subject. The mapping is arithmetic on
the given columns, so the views grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions import subject_key
from tracelight.operators.joins import keyed_join
from tracelight.schemas import ROOM_PREFIX, SUBJECT_FLAGS
from tracelight.sources.files import read_table

STUDY_START = "2024-01-01"
SECOND_ROOM_DAY = 15
# Quantity above which an event counts as detected, by event type.
DETECTION_LIMITS = {"error": 10.0, "signup": 10.0, "click": 45.0, "view": 150.0, "purchase": 60.0}
# Divisor of each subject flag that is a plain multiple test.
FLAG_DIVISORS = {
    "white_race": 3, "txp": 5, "diabetes_mellitus": 11, "heart_disease": 19, "lung_disease": 23,
    "liver_disease": 29, "hiv": 31, "onc_history": 37, "other_icu": 41, "mech_vent_ever": 13,
    "bipap_cpap_ever": 17, "dialysis": 43, "immunosuppressant_6mo": 47, "covid_rx": 53,
    "antibody_therapy": 59, "other_covid_therapy": 61, "other_immunosuppressant": 67,
    "high_flow_nc_ever": 7, "female_sex": 2,
}


def events_as_samples(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event with day, room and the integer of ``props``."""
    day = F.datediff(F.to_date("ts"), F.lit(STUDY_START).cast("date"))
    user = F.col("user_id").cast("string")
    padded = F.lpad(user, F.greatest(F.length(user), F.lit(4)), F.lit("0"))
    half = F.when(F.col("total_study_day") < SECOND_ROOM_DAY, "a").otherwise("b")
    return (
        read_table(spark, folder, "events")
        .select(
            "event_id", "user_id", "event_type", "value",
            day.alias("total_study_day"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        )
        .withColumn("subject_room_id", F.concat(F.lit(ROOM_PREFIX), padded, F.lit("_"), half))
    )


def swabs(spark: SparkSession, folder: str) -> DataFrame:
    """The swab table over ``events``; ``event_id`` is its row key."""
    samples = events_as_samples(spark, folder)
    rooms = samples.groupBy("subject_room_id").agg(F.min("total_study_day").alias("room_start"))
    users = samples.groupBy("user_id").agg(F.min("total_study_day").alias("user_start"))
    dated = keyed_join(keyed_join(samples, rooms, ["subject_room_id"]), users, ["user_id"])
    kind, even = F.col("event_type"), F.col("k") % 2 == 0
    limit = F.lit(None).cast("double")
    for name, threshold in DETECTION_LIMITS.items():
        limit = F.when(kind == name, F.lit(threshold)).otherwise(limit)
    since = F.col("total_study_day") - F.col("user_start")
    return dated.select(
        "event_id",
        "subject_room_id",
        F.col("user_id").alias("redcap_id"),
        F.concat(F.lit("M"), (F.col("user_id") % 4 + 1).cast("string")).alias("unit"),
        F.when(kind == "error", "S1").when(kind == "signup", "S2").when(kind == "click", "S3")
        .when((kind == "view") & even, "S4").when(kind == "view", "S5").otherwise("S6").alias("swab_site"),
        F.when(kind == "error", "floor_near1").when(kind == "signup", "floor_exit1")
        .when(kind == "click", "keyboard").when((kind == "view") & even, "wall_near")
        .when(kind == "view", "wall_exit").otherwise("bathroom_sink").alias("site_descriptor"),
        F.when(kind == "click", "High").otherwise("Low").alias("touch"),
        (F.col("k") / F.lit(20.0)).alias("distance"),
        (F.col("total_study_day") - F.col("room_start")).alias("subject_room_day"),
        since.alias("subject_study_day"),
        (since + F.col("user_id") % 5).cast("int").alias("subject_hosp_day"),
        since.alias("subject_covid_day"),
        "total_study_day",
        F.when(F.col("value") > limit, F.col("value")).alias("copies_max"),
    )


def subjects(spark: SparkSession, folder: str) -> DataFrame:
    """The subject table over ``customer``."""
    key = F.col("c_custkey")
    flags = {flag: key % divisor == 0 for flag, divisor in FLAG_DIVISORS.items()}
    flags["supp_oxy_ever"] = key % 3 != 0
    flags["steroid"] = key % 5 < 2
    flags["remdesivir"] = (key % 5 < 2) & (key % 2 == 0)
    return read_table(spark, folder, "customer").select(
        subject_key(key).alias("redcap_id"), *[flags[f].alias(f) for f in SUBJECT_FLAGS]
    )


def order_swabs(spark: SparkSession, folder: str) -> DataFrame:
    """A larger swab-like table over ``lineitem`` and ``orders`` for volume runs."""
    items = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_quantity", "l_discount", "l_extendedprice",
        F.concat("l_returnflag", "l_linestatus").alias("swab_site"),
    )
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("redcap_id"),
        "swab_site",
        F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).alias("total_study_day"),
        (F.col("l_quantity") / 10.0).alias("distance"),
        F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).alias("copies_max"),
    )
