"""Explicit schemas and the fixed vocabulary of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The subject attribute flags, in file order.
SUBJECT_FLAGS = [
    "female_sex",
    "white_race",
    "txp",
    "diabetes_mellitus",
    "heart_disease",
    "lung_disease",
    "liver_disease",
    "hiv",
    "onc_history",
    "other_icu",
    "mech_vent_ever",
    "supp_oxy_ever",
    "bipap_cpap_ever",
    "dialysis",
    "immunosuppressant_6mo",
    "covid_rx",
    "steroid",
    "remdesivir",
    "antibody_therapy",
    "other_covid_therapy",
    "other_immunosuppressant",
    "high_flow_nc_ever",
]

# Severity classes in level order (the first is the reference level).
SEVERITY_LEVELS = [
    "No Oxygen Support",
    "Only Nasal or Facemask Oxygen Support",
    "Significant Oxygen Support",
]

# Site patterns, category names and contact labels.
EXCLUDED_SITES = "bathroom|sink|toilet|nurse"
FLOOR_SITES = "floor"
HIGH_TOUCH_VALUE = "High"
HIGH_TOUCH_LABEL = "High Touch"
LOW_TOUCH_LABEL = "Low Touch"
SUBJECT_PREFIX = "decon_subject_"
ROOM_PREFIX = "decon_"

SUBJECTS = T.StructType(
    [T.StructField("redcap_id", T.StringType(), False)]
    + [T.StructField(flag, T.BooleanType(), True) for flag in SUBJECT_FLAGS]
)

SWABS = T.StructType(
    [
        T.StructField("subject_room_id", T.StringType()),
        T.StructField("redcap_id", T.LongType()),
        T.StructField("unit", T.StringType()),
        T.StructField("swab_site", T.StringType()),
        T.StructField("site_descriptor", T.StringType()),
        T.StructField("touch", T.StringType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("subject_room_day", T.IntegerType()),
        T.StructField("subject_study_day", T.IntegerType()),
        T.StructField("subject_hosp_day", T.IntegerType()),
        T.StructField("subject_covid_day", T.IntegerType()),
        T.StructField("total_study_day", T.IntegerType()),
        T.StructField("copies_max", T.DoubleType()),
    ]
)

DRAWS = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("chain", T.IntegerType()),
        T.StructField("iteration", T.LongType()),
        T.StructField("draw", T.LongType()),
        T.StructField("param", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# Analysis-table columns after the derivations, by variant (see operators.prep).
ANALYSIS_COLUMNS = {
    "spatial": [
        "redcap_id", "subject_covid_day", "subject_hosp_day", "swab_site", "unit",
        "site_category", "touch", "high_touch", "distance", "copies_max", "scv2_detected",
    ],
    "spatial_days": [
        "redcap_id", "subject_covid_day", "subject_hosp_day", "subject_room_day",
        "total_study_day", "swab_site", "unit", "site_category", "touch", "high_touch",
        "distance", "copies_max", "scv2_detected",
    ],
    "longitudinal": [
        "subject_room_id", "redcap_id", "subject_room_day", "subject_covid_day",
        "subject_hosp_day", "swab_site", "unit", "site_category", "touch", "high_touch",
        "distance", "copies_max", "scv2_detected",
    ],
    "longitudinal_days": [
        "subject_room_id", "redcap_id", "subject_room_day", "subject_covid_day",
        "subject_hosp_day", "total_study_day", "swab_site", "unit", "site_category",
        "touch", "high_touch", "distance", "copies_max", "scv2_detected",
    ],
}
