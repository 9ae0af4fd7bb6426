"""Queries over sources, projections, filters, joins, aggregates and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import add, on_both, on_subjects, on_swabs, tidy
from registry.sql_base import (
    LONG, LONG_DAYS, SEVERITY, SPATIAL, SPATIAL_DAYS, SUBJECTS, SWABS, query, rounded,
)
from tracelight import functions as C
from tracelight.operators import describe, grid, groups, joins, prep, quantiles, reshape
from tracelight.schemas import SUBJECT_FLAGS, SUBJECTS as SUBJECT_SCHEMA, SWABS as SWAB_SCHEMA
from tracelight.session import shared_path
from tracelight.sources import files, model_store, views

# ---------------------------------------------------------------- sources

def _csv_round_trip(spark, folder):
    path = shared_path(spark, "subjects")
    files.write_table(views.subjects(spark, folder), path, "csv")
    return tidy(files.read_csv(spark, path, SUBJECT_SCHEMA))


add("s1_csv_scan", _csv_round_trip, query(SUBJECTS, "SELECT * FROM subjects"))


def _csv_swabs(spark, folder):
    path = shared_path(spark, "swabs")
    files.write_table(views.swabs(spark, folder).select(*SWAB_SCHEMA.fieldNames()), path, "csv")
    return tidy(files.infer_csv(spark, path).groupBy("swab_site").agg(
        F.count("copies_max").alias("detected"), F.sum("total_study_day").alias("days"), F.avg("distance").alias("distance")
    ))


add("s1_csv_inferred", _csv_swabs, query(SWABS, f"""
SELECT swab_site, count(copies_max) AS detected, CAST(sum(total_study_day) AS BIGINT) AS days, {rounded('avg(distance)', 'distance')}
FROM swabs GROUP BY ALL"""))


def event_draws(spark, folder):
    """A draws table over ``events``: four dense chains of one parameter per event type pair."""
    return files.read_table(spark, folder, "events").select(
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("model_name"),
        (F.col("event_id") % 4).cast("int").alias("chain"),
        F.floor(F.col("event_id") / 4).alias("iteration"),
        F.col("event_id").alias("draw"),
        F.concat(F.lit("b_"), F.col("event_type")).alias("param"),
        "value",
    )


EVENT_DRAWS = """
event_draws AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model_name, event_id % 4 AS chain,
         event_id // 4 AS iteration, event_id AS draw, 'b_' || event_type AS param, value
  FROM events
)"""


def _store(spark, folder, model):
    path = shared_path(spark, "draws")
    model_store.write_draws(event_draws(spark, folder), path)
    return model_store.read_draws(spark, path, model)


add("s2_model_store_write", lambda spark, folder: tidy(
    _store(spark, folder, None).groupBy("model_name", "chain").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))),
    query(EVENT_DRAWS, f"SELECT model_name, chain, count(*) AS rows, {rounded('sum(value)', 'total')} FROM event_draws GROUP BY ALL"))
add("s3_model_store_read", lambda spark, folder: tidy(
    _store(spark, folder, "even").select("model_name", "chain", "iteration", "draw", "param", "value")),
    query(EVENT_DRAWS, f"SELECT model_name, chain, iteration, draw, param, {rounded('value')} FROM event_draws WHERE model_name = 'even'"))

# ---------------------------------------------------------------- projections and filters


def with_gaps(swabs):
    """Every tenth site missing, every seventh quantity NaN, every fifth contact missing."""
    event = F.col("event_id")
    return swabs.withColumns({
        "site_descriptor": F.when(event % 10 != 0, F.col("site_descriptor")),
        "copies_max": F.when(event % 7 == 0, F.lit(float("nan"))).otherwise(F.col("copies_max")),
        "touch": F.when(event % 5 != 0, F.col("touch")),
        "total_study_day": F.when(event % 11 != 0, F.col("total_study_day")),
    })


GAPS = """
gaps AS (
  SELECT * REPLACE (
    CASE WHEN event_id % 10 <> 0 THEN site_descriptor END AS site_descriptor,
    CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE copies_max END AS copies_max,
    CASE WHEN event_id % 5 <> 0 THEN touch END AS touch,
    CASE WHEN event_id % 11 <> 0 THEN total_study_day END AS total_study_day)
  FROM swabs
)"""

add("f1_site_filter", on_swabs(lambda s: prep.comparable_sites(with_gaps(s)).select("event_id", "site_descriptor")),
    query(SWABS, GAPS, """SELECT event_id, site_descriptor FROM gaps
    WHERE site_descriptor IS NULL OR NOT regexp_matches(site_descriptor, 'bathroom|sink|toilet|nurse')"""))
FLAGS = """SELECT event_id, copies_max IS NOT NULL AND NOT isnan(copies_max) AS scv2_detected,
  CASE WHEN site_descriptor LIKE '%floor%' THEN 'Floor' ELSE 'Elevated' END AS site_category, touch = 'High' AS high_touch
  FROM gaps"""
add("f2_detected", on_swabs(lambda s: prep.with_site_flags(with_gaps(s)).select("event_id", "scv2_detected")),
    query(SWABS, GAPS, f"SELECT event_id, scv2_detected FROM ({FLAGS})"))
add("f3_site_category", on_swabs(lambda s: prep.with_site_flags(with_gaps(s)).select("event_id", "site_category")),
    query(SWABS, GAPS, f"SELECT event_id, site_category FROM ({FLAGS})"))
add("f4_high_touch", on_swabs(lambda s: prep.with_site_flags(with_gaps(s)).select("event_id", "high_touch")),
    query(SWABS, GAPS, f"SELECT event_id, high_touch FROM ({FLAGS})"))
add("f5_touch_label", on_swabs(
    lambda s: prep.with_contact_label(prep.with_site_flags(with_gaps(s))).select("event_id", "high_touch")),
    query(SWABS, GAPS, f"""SELECT event_id, CASE WHEN high_touch THEN 'High Touch' WHEN NOT high_touch THEN 'Low Touch' END AS high_touch
    FROM ({FLAGS})"""))


def _subjects_with_gaps(subjects):
    number = F.regexp_extract("redcap_id", "([0-9]+)", 1).cast("bigint")
    return subjects.withColumns({
        "supp_oxy_ever": F.when(number % 4 != 0, F.col("supp_oxy_ever")),
        "mech_vent_ever": F.when(number % 9 != 0, F.col("mech_vent_ever")),
    })


SUBJECT_GAPS = """
numbered AS (SELECT *, CAST(regexp_extract(redcap_id, '([0-9]+)', 1) AS BIGINT) AS id FROM subjects),
holes AS (SELECT * REPLACE (CASE WHEN id % 4 <> 0 THEN supp_oxy_ever END AS supp_oxy_ever,
                            CASE WHEN id % 9 <> 0 THEN mech_vent_ever END AS mech_vent_ever) FROM numbered)"""
add("f6_severity", on_subjects(lambda s: prep.with_severity(_subjects_with_gaps(s)).select("redcap_id", "covid_severity")),
    query(SUBJECTS, SUBJECT_GAPS, """SELECT redcap_id, CASE
      WHEN NOT mech_vent_ever AND NOT high_flow_nc_ever AND NOT bipap_cpap_ever AND NOT supp_oxy_ever THEN 'No Oxygen Support'
      WHEN NOT mech_vent_ever AND NOT high_flow_nc_ever AND NOT bipap_cpap_ever AND supp_oxy_ever
        THEN 'Only Nasal or Facemask Oxygen Support'
      WHEN mech_vent_ever OR high_flow_nc_ever OR bipap_cpap_ever THEN 'Significant Oxygen Support' END AS covid_severity FROM holes"""))
SEVERITY_RANK = """CASE covid_severity WHEN 'No Oxygen Support' THEN 1 WHEN 'Only Nasal or Facemask Oxygen Support' THEN 2
  WHEN 'Significant Oxygen Support' THEN 3 END"""
add("f7_factor_levels", on_subjects(lambda s: prep.with_severity(s).select(
    "redcap_id", C.severity_rank(F.col("covid_severity")).alias("level"))),
    query(SUBJECTS, f"SELECT redcap_id, CAST({SEVERITY_RANK} AS BIGINT) AS level FROM graded"))
add("f8_select_once", on_swabs(lambda s: prep.select_once(
    s, ["event_id", "distance", "unit", "distance", "touch", "distance"])),
    query(SWABS, f"SELECT event_id, {rounded('distance')}, unit, touch FROM swabs"))
add("f9_drop_pattern", on_swabs(lambda s: prep.keep_first(prep.drop_matching(s, "_day"), "distance")),
    query(SWABS, f"""SELECT event_id, subject_room_id, redcap_id, unit, swab_site, site_descriptor, touch, {rounded('distance')},
    {rounded('copies_max')} FROM swabs"""))
GRID_SQL = """
axes AS (SELECT min(distance) AS lo, max(distance) AS hi FROM longitudinal_days),
sites AS (SELECT DISTINCT site_category FROM longitudinal_days),
touches AS (SELECT DISTINCT high_touch FROM longitudinal_days),
grid AS (
  SELECT lo + i * (hi - lo) / 29 AS distance, site_category, high_touch
  FROM axes, range(30) r(i), sites, touches
)"""


def _grid(swabs, drop):
    table = prep.analysis_table(swabs, "longitudinal_days")
    return grid.prediction_grid(table, {"distance": 30}, ["site_category", "high_touch"], drop_impossible=drop)


IMPOSSIBLE = "NOT (high_touch AND site_category = 'Floor')"
add("j6_prediction_grid", on_swabs(lambda s: _grid(s, False)),
    query(SWABS, LONG_DAYS, GRID_SQL, f"SELECT {rounded('distance')}, site_category, high_touch FROM grid"))
add("f10_possible_cells", on_swabs(lambda s: _grid(s, True)),
    query(SWABS, LONG_DAYS, GRID_SQL, f"SELECT {rounded('distance')}, site_category, high_touch FROM grid WHERE {IMPOSSIBLE}"))
add("f11_null_to_zero", on_swabs(lambda s: with_gaps(s).select("event_id", C.null_to_zero(F.col("copies_max")).alias("copies_max"))),
    query(SWABS, GAPS, f"""SELECT event_id, {rounded('CASE WHEN copies_max IS NULL OR isnan(copies_max) THEN 0 ELSE copies_max END', 'copies_max')}
    FROM gaps"""))
add("f12_replace_where", on_swabs(lambda s: s.select("event_id", C.replace_where(
    F.col("unit"), F.col("unit") == "M1", F.lit("R1")).alias("unit"), C.replace_where(
    F.col("distance"), F.col("distance") <= 0.75, F.lit(None)).alias("distance"))),
    query(SWABS, f"""SELECT event_id, CASE WHEN unit = 'M1' THEN 'R1' ELSE unit END AS unit,
    {rounded('CASE WHEN distance <= 0.75 THEN NULL ELSE distance END', 'distance')} FROM swabs"""))
add("f13_touched_or_floor", on_swabs(lambda s: prep.touched_or_floor(prep.with_site_flags(with_gaps(s))).select("event_id", "site_category")),
    query(SWABS, GAPS, f"SELECT event_id, site_category FROM ({FLAGS}) WHERE (site_category = 'Elevated' AND high_touch) OR site_category = 'Floor'"))
add("f14_at_minimum", on_swabs(lambda s: prep.at_minimum(s, "distance").select("event_id", "distance")),
    query(SWABS, f"SELECT event_id, {rounded('distance')} FROM swabs WHERE distance = (SELECT min(distance) FROM swabs)"))
add("f14_nearest_point", on_swabs(lambda s: prep.nearest_to(_grid(s, True), "distance", 2.0)),
    query(SWABS, LONG_DAYS, GRID_SQL, f"""SELECT {rounded('distance')}, site_category, high_touch FROM grid WHERE {IMPOSSIBLE}
    AND distance = (SELECT distance FROM grid ORDER BY abs(distance - 2.0), distance LIMIT 1)"""))
add("f15_scalar", on_swabs(lambda s: describe.detection_by(s, ["swab_site"]).where("swab_site = 'S1'").select("prop_positive")),
    query(SWABS, f"SELECT {rounded('avg(CAST(copies_max IS NOT NULL AS INTEGER))', 'prop_positive')} FROM swabs WHERE swab_site = 'S1'"))

# ---------------------------------------------------------------- joins and keys

add("k1_subject_key", on_swabs(lambda s: prep.with_subject_key(
    s.withColumn("redcap_id", F.when(F.col("event_id") % 13 != 0, F.col("redcap_id").cast("double")))).select("event_id", "redcap_id")),
    query(SWABS, "SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN 'decon_subject_' || CAST(redcap_id AS VARCHAR) END AS redcap_id FROM swabs"))


def _missing_keys(swabs, subjects):
    """Null keys on both sides; a third of the subjects have another key, so they match nothing."""
    left = prep.with_subject_key(swabs.withColumn(
        "redcap_id", F.when(F.col("event_id") % 17 != 0, F.col("redcap_id")))).select("event_id", "redcap_id")
    number = F.regexp_extract("redcap_id", "([0-9]+)", 1).cast("bigint")
    key = F.when(number % 3 == 1, F.concat(F.lit("other_"), "redcap_id")).when(number != 0, F.col("redcap_id"))
    right = prep.with_severity(subjects).select(key.alias("redcap_id"), "covid_severity")
    return joins.subject_attributes(left, right, ["covid_severity"])


add("j1_subject_attributes", on_both(_missing_keys), query(SWABS, SUBJECTS, """
sides AS (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN 'decon_subject_' || CAST(redcap_id AS VARCHAR) END AS redcap_id FROM swabs),
attributes AS (SELECT CASE WHEN CAST(regexp_extract(redcap_id, '([0-9]+)', 1) AS BIGINT) % 3 = 1 THEN 'other_' || redcap_id
               WHEN redcap_id <> 'decon_subject_0' THEN redcap_id END AS redcap_id, covid_severity FROM graded)""", """
SELECT s.event_id, s.redcap_id, a.covid_severity FROM sides s LEFT JOIN attributes a ON s.redcap_id IS NOT DISTINCT FROM a.redcap_id"""))
add("j2_room_first_day", on_swabs(lambda s: joins.group_lookup(
    s.select("event_id", "subject_room_id"), with_gaps(s), ["subject_room_id"], {"pandemic_index": F.min("total_study_day")})),
    query(SWABS, GAPS, """SELECT event_id, subject_room_id, CAST(pandemic_index AS BIGINT) AS pandemic_index FROM swabs
    LEFT JOIN (SELECT subject_room_id, min(total_study_day) AS pandemic_index FROM gaps GROUP BY 1) USING (subject_room_id)"""))
add("j3_room_first_values", on_swabs(lambda s: s.groupBy("subject_room_id").agg(
    F.min("total_study_day").alias("total_study_day"), F.min("subject_room_day").alias("subject_room_day"),
    F.min_by("unit", F.struct("total_study_day", "swab_site", "unit")).alias("unit"))),
    query(SWABS, """SELECT subject_room_id, CAST(min(total_study_day) AS BIGINT) AS total_study_day,
    CAST(min(subject_room_day) AS BIGINT) AS subject_room_day, first(unit ORDER BY total_study_day, swab_site, unit) AS unit
    FROM swabs GROUP BY 1"""))
add("j4_site_lookup", on_swabs(lambda s: joins.distinct_lookup(
    s.select("event_id", "swab_site"), s, ["swab_site"], ["site_descriptor"])),
    query(SWABS, """SELECT event_id, swab_site, site_descriptor FROM (SELECT event_id, swab_site FROM swabs)
    LEFT JOIN (SELECT DISTINCT swab_site, site_descriptor FROM swabs) USING (swab_site)"""))


def _room_severity(swabs, subjects):
    table = prep.analysis_table(swabs, "severity", subjects)
    rooms = joins.one_per_key(table, ["subject_room_id"], ["covid_severity"])
    return joins.keyed_join(describe.detection_by(swabs, ["subject_room_id"]), rooms, ["subject_room_id"])


add("j5_room_severity", on_both(_room_severity), query(SWABS, SUBJECTS, SEVERITY, f"""
SELECT subject_room_id, {rounded('prop_positive')}, covid_severity
FROM (SELECT subject_room_id, avg(CAST(copies_max IS NOT NULL AS INTEGER)) AS prop_positive FROM swabs GROUP BY 1)
LEFT JOIN (SELECT subject_room_id, min(covid_severity) AS covid_severity FROM severity GROUP BY 1) USING (subject_room_id)"""))

# ---------------------------------------------------------------- aggregates

PROP = rounded("avg(CAST(copies_max IS NOT NULL AS INTEGER))", "prop_positive")
for _name, _keys in describe.DETECTION_KEYS.items():
    _first = _name in ("site", "unit", "room", "room_unit")

    def _detection(swabs, keys=tuple(_keys), first=_first):
        return describe.detection_by(groups.first_samples(swabs) if first else swabs, keys)

    _cast = ", ".join(f"CAST({k} AS BIGINT) AS {k}" if k.endswith("_day") else k for k in _keys)
    add(f"a1_detection_{_name}", on_swabs(_detection),
        query(SWABS, f"SELECT {_cast}, {PROP} FROM {'first_samples' if _first else 'swabs'} GROUP BY {', '.join(_keys)}"))

SHOWN = "regexp_replace(CAST(round_even({}, 1) AS VARCHAR), '\\.0$', '')"
SURFACES = f"""
labelled AS (
  SELECT l.site_category, array_to_string(list_transform(string_split(replace(regexp_replace(d.site_descriptor, '1|2', '', 'g'), '_', ' '), ' '),
           lambda w: upper(w[1]) || lower(w[2:])), ' ') AS site_descriptor,
         CASE WHEN high_touch THEN 'High Touch' WHEN NOT high_touch THEN 'Low Touch' END AS high_touch,
         subject_room_id, copies_max
  FROM longitudinal_days l LEFT JOIN (SELECT DISTINCT swab_site, site_descriptor FROM swabs) d USING (swab_site)
),
surfaces AS (
  SELECT site_category, site_descriptor, high_touch, count(DISTINCT subject_room_id) AS unique_subjects,
         count(*) AS unique_specimens, avg(CAST(copies_max IS NOT NULL AS INTEGER)) AS prop_positive,
         quantile_cont(log10(copies_max), 0.5) AS med_copies, quantile_cont(log10(copies_max), 0.25) AS q25_copies,
         quantile_cont(log10(copies_max), 0.75) AS q75_copies
  FROM labelled GROUP BY ALL
)"""
SUMMARY = f"{SHOWN.format('med_copies')} || ' (' || {SHOWN.format('q25_copies')} || ' - ' || {{}} || ')'"
SURFACE_SELECT = (
    "SELECT site_category, site_descriptor, high_touch, unique_subjects, unique_specimens, "
    + ", ".join(rounded(c) for c in ("prop_positive", "med_copies", "q25_copies", "{}"))
    + ", {} AS copies_summary FROM surfaces"
)


def surface_summary(swabs, compat=False):
    return describe.surface_table(prep.analysis_table(swabs, "longitudinal_days"), swabs, compat)


add("a2_surface_table", on_swabs(surface_summary), query(SWABS, LONG_DAYS, SURFACES, f"""
SELECT site_category, site_descriptor, high_touch, unique_subjects, unique_specimens, {rounded('prop_positive')},
{rounded('med_copies')}, {rounded('q25_copies')}, {rounded('q75_copies')},
{SUMMARY.format(SHOWN.format('q75_copies'))} AS copies_summary FROM surfaces"""))
add("a5_surface_table_compat", on_swabs(lambda s: surface_summary(s, True)), query(SWABS, LONG_DAYS, SURFACES, f"""
SELECT site_category, site_descriptor, high_touch, unique_subjects, unique_specimens, {rounded('prop_positive')},
{rounded('med_copies')}, {rounded('q25_copies')}, {rounded('med_copies', 'q75_copies')},
{SUMMARY.format(SHOWN.format('med_copies'))} AS copies_summary FROM surfaces"""))


def _printed(spark, folder):
    path = shared_path(spark, "surfaces")
    files.write_table(describe.printed_surface_table(surface_summary(views.swabs(spark, folder))), path)
    return tidy(spark.read.parquet(path))


add("s4_table_sink", _printed, query(SWABS, LONG_DAYS, SURFACES, f"""
SELECT site_category AS "Height", site_descriptor AS "Location", high_touch AS "Contact", unique_subjects AS "Subjects Sampled",
unique_specimens AS "Surfaces Sampled", printf('%.1f%%', 100 * prop_positive) AS "Detected",
{SUMMARY.format(SHOWN.format('q75_copies'))} AS "Median (IQR) log10 Copies" FROM surfaces"""))
add("a3_distinct_rooms", on_swabs(lambda s: s.withColumn(
    "subject_room_id", F.when(F.col("event_id") % 3 != 0, F.col("subject_room_id"))).groupBy("swab_site").agg(
    describe.count_distinct_with_null("subject_room_id").alias("rooms"))),
    query(SWABS, """SELECT swab_site, count(DISTINCT r) + max(CAST(r IS NULL AS INTEGER)) AS rooms
    FROM (SELECT swab_site, CASE WHEN event_id % 3 <> 0 THEN subject_room_id END AS r FROM swabs) GROUP BY 1"""))
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
add("a4_quantiles", on_swabs(lambda s: quantiles.exact_quantiles(s, ["unit", "swab_site"], "copies_max", QUARTILES)),
    query(SWABS, f"""SELECT unit, swab_site, {rounded('quantile_cont(copies_max, 0.25)', 'q25')},
    {rounded('quantile_cont(copies_max, 0.5)', 'median')}, {rounded('quantile_cont(copies_max, 0.75)', 'q75')}
    FROM swabs WHERE copies_max IS NOT NULL GROUP BY 1, 2"""))
add("a4_quantiles_chunked", lambda spark, folder: tidy(quantiles.exact_quantiles(
    views.order_swabs(spark, folder), ["swab_site"], "copies_max", QUARTILES, buffered_rows=1000)), f"""
    SELECT l_returnflag || l_linestatus AS swab_site, {rounded('quantile_cont(l_extendedprice, 0.25)', 'q25')},
    {rounded('quantile_cont(l_extendedprice, 0.5)', 'median')}, {rounded('quantile_cont(l_extendedprice, 0.75)', 'q75')}
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount > 0.05 GROUP BY 1""")
TREATMENT = ["mech_vent_ever", "bipap_cpap_ever", "high_flow_nc_ever", "supp_oxy_ever", "steroid", "remdesivir"]
add("a6_counts", on_subjects(lambda s: describe.counts_by(s, TREATMENT)),
    query(SUBJECTS, f"SELECT {', '.join(TREATMENT)}, count(*) AS count FROM subjects GROUP BY ALL"))


def _severity_shares(subjects):
    counts = describe.counts_by(prep.with_severity(subjects), ["covid_severity"])
    return describe.share_of_total(counts).withColumn("label", describe.share_text(F.col("percent")))


def signif_sql(value: str, digits: int) -> str:
    scale = f"pow(10, floor(log10(abs({value}))) - {digits - 1})"
    return f"CASE WHEN {value} = 0 THEN 0.0 ELSE round({value} / {scale}) * {scale} END"


SHARES = """shares AS (SELECT covid_severity, count(*) AS count, count(*) / sum(count(*)) OVER () * 100.0 AS percent FROM graded GROUP BY 1)"""
LABEL = f"regexp_replace(CAST({signif_sql('percent', 3)} AS VARCHAR), '\\.0$', '') || '%' AS label"
add("a7_share_of_total", on_subjects(_severity_shares), query(SUBJECTS, SHARES, f"SELECT covid_severity, count, {rounded('percent')}, {LABEL} FROM shares"))
add("o4_level_order", on_subjects(lambda s: describe.sort_asc(_severity_shares(s).withColumn(
    "level", C.severity_rank(F.col("covid_severity"))), ["level"]).where(F.col("level") <= 2)),
    query(SUBJECTS, SHARES, f"SELECT covid_severity, count, {rounded('percent')}, {LABEL}, CAST({SEVERITY_RANK} AS BIGINT) AS level FROM shares WHERE {SEVERITY_RANK} <= 2"))
TOTALS = ", ".join(
    f"CAST(sum(CAST({f} AS INTEGER)) AS DOUBLE) AS {f}_count, {rounded(f'sum(CAST({f} AS INTEGER)) / count(*)', f + '_proportion')}"
    for f in SUBJECT_FLAGS
)
add("a8_flag_totals", on_subjects(describe.flag_totals), query(SUBJECTS, f"SELECT {TOTALS} FROM subjects"))
add("a9_distinct", on_swabs(lambda s: prep.analysis_table(s, "spatial")),
    query(SWABS, SPATIAL, f"""SELECT redcap_id, CAST(subject_covid_day AS BIGINT) AS subject_covid_day, CAST(subject_hosp_day AS BIGINT) AS subject_hosp_day,
    swab_site, unit, site_category, touch, high_touch, {rounded('distance')}, {rounded('copies_max')}, scv2_detected FROM spatial"""))
DAYS = "CAST(subject_room_day AS BIGINT) AS subject_room_day, CAST(subject_covid_day AS BIGINT) AS subject_covid_day, CAST(subject_hosp_day AS BIGINT) AS subject_hosp_day"
REST = f"swab_site, unit, site_category, touch, high_touch, {rounded('distance')}, {rounded('copies_max')}, scv2_detected"
add("a9_analysis_spatial_days", on_swabs(lambda s: prep.analysis_table(s, "spatial_days")),
    query(SWABS, SPATIAL_DAYS, f"SELECT redcap_id, {DAYS}, CAST(total_study_day AS BIGINT) AS total_study_day, {REST} FROM spatial_days"))
add("a9_analysis_longitudinal", on_swabs(lambda s: prep.analysis_table(s, "longitudinal")),
    query(SWABS, LONG, f"SELECT subject_room_id, redcap_id, {DAYS}, {REST} FROM longitudinal"))
add("a9_analysis_longitudinal_days", on_swabs(lambda s: prep.analysis_table(s, "longitudinal_days")),
    query(SWABS, LONG_DAYS, f"SELECT subject_room_id, redcap_id, {DAYS}, CAST(total_study_day AS BIGINT) AS total_study_day, {REST} FROM longitudinal_days"))
add("a9_analysis_severity", on_both(lambda s, p: prep.analysis_table(s, "severity", p)),
    query(SWABS, SUBJECTS, SEVERITY, f"SELECT subject_room_id, redcap_id, {DAYS}, CAST(total_study_day AS BIGINT) AS total_study_day, {REST}, covid_severity FROM severity"))
add("a10_cohort_counters", on_swabs(lambda s: describe.cohort_counters(prep.analysis_table(s, "longitudinal_days"))),
    query(SWABS, LONG_DAYS, """SELECT count(*) AS specimens, count(DISTINCT subject_room_id) AS rooms, count(DISTINCT redcap_id) AS subjects,
    (SELECT count(*) FROM (SELECT redcap_id FROM longitudinal_days GROUP BY 1 HAVING count(DISTINCT subject_room_id) > 1)) AS transferred
    FROM longitudinal_days"""))
add("a11_sampling_events", on_swabs(lambda s: describe.sampling_events(prep.analysis_table(s, "longitudinal_days"))),
    query(SWABS, LONG_DAYS, """per_room AS (SELECT subject_room_id, count(DISTINCT subject_room_day) AS n FROM longitudinal_days GROUP BY 1),
    moments AS (SELECT avg(n) AS m, stddev_samp(n) AS s FROM per_room)""",
          f"SELECT {rounded(signif_sql('m', 2), 'mean_events')}, {rounded(signif_sql('s', 2), 'sd_events')} FROM moments"))
add("a12_number_summary", on_swabs(lambda s: describe.number_summary(s, "copies_max", ["unit"])),
    query(SWABS, f"""SELECT unit, {rounded('min(copies_max)', 'min')}, {rounded('avg(copies_max)', 'mean')},
    {rounded('stddev_samp(copies_max)', 'sd')} FROM swabs GROUP BY 1"""))

# ---------------------------------------------------------------- groups and windows

FIRST = "SELECT event_id, subject_room_id, CAST(subject_room_day AS BIGINT) AS subject_room_day FROM first_samples"
add("w1_first_samples", on_swabs(lambda s: groups.first_samples(s).select("event_id", "subject_room_id", "subject_room_day")),
    query(SWABS, FIRST))
add("w1_first_samples_strict", on_swabs(lambda s: groups.first_samples(
    with_gaps(s), ["subject_room_id", "swab_site"], "total_study_day", strict_na=True).select("event_id", "subject_room_id")),
    query(SWABS, GAPS, """SELECT event_id, subject_room_id FROM gaps
    WINDOW w AS (PARTITION BY subject_room_id, swab_site)
    QUALIFY total_study_day = min(total_study_day) OVER w AND count(*) OVER w = count(total_study_day) OVER w"""))
add("w2_first_by_subject", on_swabs(lambda s: groups.first_samples(s, ["redcap_id"], "subject_covid_day").select("event_id", "redcap_id")),
    query(SWABS, "SELECT event_id, redcap_id FROM swabs QUALIFY subject_covid_day = min(subject_covid_day) OVER (PARTITION BY redcap_id)"))
add("w3_offset_from_start", on_swabs(lambda s: groups.offset_from_start(
    s, ["redcap_id", "unit"], "subject_hosp_day", "offset").select("event_id", "offset")),
    query(SWABS, "SELECT event_id, CAST(subject_hosp_day - min(subject_hosp_day) OVER (PARTITION BY redcap_id, unit) AS BIGINT) AS \"offset\" FROM swabs"))


def _dense(swabs):
    keys = F.concat(F.lit("decon_"), F.col("redcap_id").cast("string"), F.lit("_"), F.col("unit"))
    ids = groups.dense_ids(swabs, keys)
    return ids.select("key", "id", C.room_key(F.col("id")).alias("room"))


add("w4_dense_ids", on_swabs(_dense), query(SWABS, """ids AS (
    SELECT key, row_number() OVER (ORDER BY key) AS id FROM (SELECT DISTINCT 'decon_' || CAST(redcap_id AS VARCHAR) || '_' || unit AS key FROM swabs))""",
    "SELECT key, id, 'decon_' || lpad(CAST(id AS VARCHAR), CAST(greatest(length(CAST(id AS VARCHAR)), 3) AS INTEGER), '0') AS room FROM ids"))
add("w5_standard_score", on_swabs(lambda s: groups.standard_score(s, "subject_covid_day", "score").select("event_id", "score")),
    query(SWABS, f"SELECT event_id, {rounded('(subject_covid_day - avg(subject_covid_day) OVER ()) / stddev_samp(subject_covid_day) OVER ()', 'score')} FROM swabs"))
add("w6_undo_standard_score", on_swabs(lambda s: groups.undo_standard_score(
    groups.standard_score(s, "subject_covid_day", "score").select("event_id", "score"), "score", s, "subject_covid_day", "day")),
    query(SWABS, f"""SELECT event_id, {rounded('(subject_covid_day - avg(subject_covid_day) OVER ()) / stddev_samp(subject_covid_day) OVER ()', 'score')},
    {rounded('CAST(subject_covid_day AS DOUBLE)', 'day')} FROM swabs"""))

# ---------------------------------------------------------------- sorting, stacking, reshaping

add("o1_sort_desc", on_swabs(lambda s: describe.sort_desc(describe.detection_by(groups.first_samples(s), ["unit"]), ["prop_positive"], ["unit"])),
    query(SWABS, f"SELECT unit, {PROP} FROM first_samples GROUP BY 1 ORDER BY 2 DESC"))
add("o2_sort_within", on_swabs(lambda s: describe.sort_within(describe.detection_by(
    groups.first_samples(s), ["subject_room_id", "unit"]), "unit", "prop_positive", ["subject_room_id"])),
    query(SWABS, f"SELECT subject_room_id, unit, {PROP} FROM first_samples GROUP BY 1, 2 ORDER BY 2, 3 DESC, 1"))
add("o3_sort_asc", on_swabs(lambda s: describe.sort_asc(
    s.select("event_id", "redcap_id", "subject_study_day"), ["redcap_id", "subject_study_day", "event_id"])),
    query(SWABS, "SELECT event_id, redcap_id, CAST(subject_study_day AS BIGINT) AS subject_study_day FROM swabs ORDER BY 2, 3, 1"))
add("u1_stack", on_swabs(lambda s: reshape.stack({
    "first": describe.detection_by(groups.first_samples(s), ["unit"]), "all": describe.detection_by(s, ["unit"])})),
    query(SWABS, f"SELECT 'first' AS model_name, unit, {PROP} FROM first_samples GROUP BY 2 UNION ALL SELECT 'all', unit, {PROP} FROM swabs GROUP BY 2"))
LONG_FLAGS = " UNION ALL ".join(
    f"SELECT '{f}_{m}' AS name, {v} AS value FROM subjects"
    for f in SUBJECT_FLAGS
    for m, v in (("count", f"CAST(sum(CAST({f} AS INTEGER)) AS DOUBLE)"), ("proportion", f"sum(CAST({f} AS INTEGER)) / count(*)"))
)
add("r1_longer", on_subjects(lambda s: reshape.longer(describe.flag_totals(s))),
    query(SUBJECTS, f"SELECT name, {rounded('value')} FROM ({LONG_FLAGS})"))
add("r2_flag_summary", on_subjects(lambda s: describe.sort_desc(reshape.flag_summary(describe.flag_totals(s)), ["proportion"], ["name"])),
    query(SUBJECTS, " UNION ALL ".join(
        f"SELECT '{f}' AS name, CAST(sum(CAST({f} AS INTEGER)) AS DOUBLE) AS count, {rounded(f'sum(CAST({f} AS INTEGER)) / count(*)', 'proportion')} FROM subjects"
        for f in SUBJECT_FLAGS)))
add("r3_wider", on_swabs(lambda s: reshape.floor_against_touched(describe.detection_by(
    prep.touched_or_floor(prep.with_site_flags(prep.comparable_sites(s))), ["subject_room_id", "site_category"]).withColumnRenamed(
    "prop_positive", "epred"), s)),
    query(SWABS, LONG, f"""
    shares AS (SELECT subject_room_id, CASE WHEN site_descriptor LIKE '%floor%' THEN 'Floor' ELSE 'Elevated' END AS c,
      avg(CAST(copies_max IS NOT NULL AS INTEGER)) AS v FROM swabs WHERE site_descriptor LIKE '%floor%' OR touch = 'High' GROUP BY 1, 2),
    firsts AS (SELECT subject_room_id, min(total_study_day) AS total_study_day, min(subject_room_day) AS subject_room_day,
      first(unit ORDER BY total_study_day, swab_site, unit) AS unit FROM swabs GROUP BY 1)""", f"""
    SELECT subject_room_id, {rounded("max(v) FILTER (c = 'Floor')", '"Floor"')}, {rounded("max(v) FILTER (c = 'Elevated')", '"Elevated"')},
    replace(subject_room_id, 'decon_', '') AS numeric_id, CAST(any_value(total_study_day) AS BIGINT) AS total_study_day,
    CAST(any_value(subject_room_day) AS BIGINT) AS subject_room_day, any_value(unit) AS unit
    FROM shares JOIN firsts USING (subject_room_id) GROUP BY 1"""))

# ---------------------------------------------------------------- scalar functions

TITLE = """array_to_string(list_transform(string_split(replace({}, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"""
add("x1_title_case", on_swabs(lambda s: s.select("event_id", C.title_words(F.col("site_descriptor")).alias("site"))),
    query(SWABS, f"SELECT event_id, {TITLE.format('site_descriptor')} AS site FROM swabs"))
add("x2_regex_replace", on_swabs(lambda s: s.select("event_id", C.strip_digits(F.col("site_descriptor")).alias("site"),
    F.regexp_replace("subject_room_id", "decon_", "").alias("room"))),
    query(SWABS, "SELECT event_id, regexp_replace(site_descriptor, '1|2', '', 'g') AS site, replace(subject_room_id, 'decon_', '') AS room FROM swabs"))
add("x3_regex_extract", on_swabs(lambda s: s.select("event_id", C.extract_word(F.col("site_descriptor"), "near|exit").alias("place"))),
    query(SWABS, "SELECT event_id, nullif(regexp_extract(site_descriptor, 'near|exit'), '') AS place FROM swabs"))
add("x4_concat", on_swabs(lambda s: prep.with_contact_label(prep.with_site_flags(s)).select(
    "event_id", F.concat("site_category", F.lit(" "), "high_touch").alias("site_category_touch"))),
    query(SWABS, """SELECT event_id, CASE WHEN site_descriptor LIKE '%floor%' THEN 'Floor' ELSE 'Elevated' END || ' ' ||
    CASE WHEN touch = 'High' THEN 'High Touch' ELSE 'Low Touch' END AS site_category_touch FROM swabs"""))
add("x5_log10", on_swabs(lambda s: s.select("event_id", C.log10_abundance(F.col("copies_max")).alias("log_copies"))),
    query(SWABS, f"SELECT event_id, {rounded('log10(copies_max)', 'log_copies')} FROM swabs"))
add("x6_exp_numeric", on_swabs(lambda s: prep.map_numeric(describe.detection_by(s, ["unit"]), F.exp, "exp")),
    query(SWABS, f"SELECT unit, {PROP}, {rounded('exp(avg(CAST(copies_max IS NOT NULL AS INTEGER)))', 'prop_positive_exp')} FROM swabs GROUP BY 1"))
add("x7_significant", on_swabs(lambda s: s.select("event_id", C.significant(F.col("copies_max"), 3).alias("s3"),
    C.significant(F.col("distance"), 2).alias("s2"))),
    query(SWABS, f"SELECT event_id, {rounded(signif_sql('copies_max', 3), 's3')}, {rounded(signif_sql('distance', 2), 's2')} FROM swabs"))
add("x8_round_half_even", on_swabs(lambda s: s.select("event_id", C.round_half_even(F.col("copies_max"), 1).alias("copies_max"))),
    query(SWABS, f"SELECT event_id, {rounded('CAST(round_even(CAST(CAST(copies_max AS VARCHAR) AS DECIMAL(18,6)), 1) AS DOUBLE)', 'copies_max')} FROM swabs"))
add("x9_percent_text", on_swabs(lambda s: describe.detection_by(s, ["unit", "swab_site"]).withColumn(
    "prop_positive", C.percent_text(F.col("prop_positive")))),
    query(SWABS, "SELECT unit, swab_site, printf('%.1f%%', 100 * avg(CAST(copies_max IS NOT NULL AS INTEGER))) AS prop_positive FROM swabs GROUP BY 1, 2"))
add("x10_template", on_swabs(lambda s: s.where("copies_max IS NOT NULL").select("event_id", C.spread_text(*[
    C.tidy_number(C.round_half_even(F.col(c) * 1.0, 0)) for c in ("copies_max", "total_study_day", "subject_room_day")]).alias("label"))),
    query(SWABS, """SELECT event_id, CAST(CAST(round_even(copies_max, 0) AS BIGINT) AS VARCHAR) || ' (' || CAST(total_study_day AS VARCHAR) || ' - ' ||
    CAST(subject_room_day AS VARCHAR) || ')' AS label FROM swabs WHERE copies_max IS NOT NULL"""))
add("x11_even_grid", on_swabs(lambda s: s.groupBy("unit").agg(C.even_grid(
    F.min("total_study_day").cast("double"), F.max("total_study_day").cast("double"), 40).alias("points")).select("unit", F.explode("points").alias("day"))),
    query(SWABS, f"SELECT unit, {rounded('lo + i * (hi - lo) / 39.0', 'day')} FROM (SELECT unit, min(total_study_day) AS lo, max(total_study_day) AS hi FROM swabs GROUP BY 1), range(40) r(i)"))
add("x12_unique_values", on_swabs(lambda s: grid.distinct_values(with_gaps(s), "site_descriptor")),
    query(SWABS, GAPS, "SELECT DISTINCT site_descriptor FROM gaps WHERE site_descriptor IS NOT NULL"))
add("x13_rename", on_swabs(lambda s: describe.detection_by(s, ["unit"]).withColumnsRenamed({"unit": "Unit", "prop_positive": "Detected"})),
    query(SWABS, f"SELECT unit AS \"Unit\", {PROP.replace('AS prop_positive', 'AS')} \"Detected\" FROM swabs GROUP BY 1"))
add("x14_log_axis", on_swabs(lambda s: groups.first_samples(s).where("copies_max IS NOT NULL").select(
    "event_id", "swab_site", "distance", C.log10_abundance(F.col("copies_max")).alias("y"))),
    query(SWABS, f"SELECT event_id, swab_site, {rounded('distance')}, {rounded('log10(copies_max)', 'y')} FROM first_samples WHERE copies_max IS NOT NULL"))
