"""Common table expressions the SQL twins start from."""

from __future__ import annotations

ROOM = (
    "'decon_' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(length(CAST(user_id AS VARCHAR)), 4) AS INTEGER), '0')"
    " || '_' || CASE WHEN total_study_day < 15 THEN 'a' ELSE 'b' END"
)

SWABS = f"""
samples AS (
  SELECT event_id, user_id, event_type, value,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS total_study_day,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events
),
roomed AS (SELECT *, {ROOM} AS subject_room_id FROM samples),
swabs AS (
  SELECT event_id, subject_room_id, user_id AS redcap_id,
         'M' || CAST(user_id % 4 + 1 AS VARCHAR) AS unit,
         CASE event_type WHEN 'error' THEN 'S1' WHEN 'signup' THEN 'S2' WHEN 'click' THEN 'S3'
              WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'S4' ELSE 'S5' END ELSE 'S6' END AS swab_site,
         CASE event_type WHEN 'error' THEN 'floor_near1' WHEN 'signup' THEN 'floor_exit1'
              WHEN 'click' THEN 'keyboard'
              WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'wall_near' ELSE 'wall_exit' END
              ELSE 'bathroom_sink' END AS site_descriptor,
         CASE WHEN event_type = 'click' THEN 'High' ELSE 'Low' END AS touch,
         CAST(k AS DOUBLE) / 20 AS distance,
         total_study_day - min(total_study_day) OVER (PARTITION BY subject_room_id) AS subject_room_day,
         total_study_day - min(total_study_day) OVER (PARTITION BY user_id) AS subject_study_day,
         total_study_day - min(total_study_day) OVER (PARTITION BY user_id) + user_id % 5 AS subject_hosp_day,
         total_study_day - min(total_study_day) OVER (PARTITION BY user_id) AS subject_covid_day,
         total_study_day,
         CASE WHEN value > CASE event_type WHEN 'error' THEN 10 WHEN 'signup' THEN 10 WHEN 'click' THEN 45
                                WHEN 'view' THEN 150 ELSE 60 END THEN value END AS copies_max
  FROM roomed
),
first_samples AS (
  SELECT * FROM swabs
  QUALIFY subject_room_day = min(subject_room_day) OVER (PARTITION BY subject_room_id)
)"""

SUBJECTS = """
subjects AS (
  SELECT 'decon_subject_' || CAST(c_custkey AS VARCHAR) AS redcap_id,
         c_custkey % 2 = 0 AS female_sex, c_custkey % 3 = 0 AS white_race, c_custkey % 5 = 0 AS txp,
         c_custkey % 11 = 0 AS diabetes_mellitus, c_custkey % 19 = 0 AS heart_disease,
         c_custkey % 23 = 0 AS lung_disease, c_custkey % 29 = 0 AS liver_disease, c_custkey % 31 = 0 AS hiv,
         c_custkey % 37 = 0 AS onc_history, c_custkey % 41 = 0 AS other_icu,
         c_custkey % 13 = 0 AS mech_vent_ever, c_custkey % 3 <> 0 AS supp_oxy_ever,
         c_custkey % 17 = 0 AS bipap_cpap_ever, c_custkey % 43 = 0 AS dialysis,
         c_custkey % 47 = 0 AS immunosuppressant_6mo, c_custkey % 53 = 0 AS covid_rx,
         c_custkey % 5 < 2 AS steroid, c_custkey % 5 < 2 AND c_custkey % 2 = 0 AS remdesivir,
         c_custkey % 59 = 0 AS antibody_therapy, c_custkey % 61 = 0 AS other_covid_therapy,
         c_custkey % 67 = 0 AS other_immunosuppressant, c_custkey % 7 = 0 AS high_flow_nc_ever
  FROM customer
),
graded AS (
  SELECT *, CASE
    WHEN NOT mech_vent_ever AND NOT high_flow_nc_ever AND NOT bipap_cpap_ever AND NOT supp_oxy_ever
      THEN 'No Oxygen Support'
    WHEN NOT mech_vent_ever AND NOT high_flow_nc_ever AND NOT bipap_cpap_ever AND supp_oxy_ever
      THEN 'Only Nasal or Facemask Oxygen Support'
    WHEN mech_vent_ever OR high_flow_nc_ever OR bipap_cpap_ever THEN 'Significant Oxygen Support' END
    AS covid_severity
  FROM subjects
)"""


def analysis(name: str, source: str, columns: str, text_key: bool) -> str:
    """CTE of one analysis-table variant."""
    key = "'decon_subject_' || CAST(redcap_id AS VARCHAR)" if text_key else "redcap_id"
    picked = ", ".join(f"{key} AS redcap_id" if c == "redcap_id" else c for c in columns.split())
    return f"""
{name} AS (
  SELECT DISTINCT {picked}
  FROM (SELECT *, copies_max IS NOT NULL AS scv2_detected,
               CASE WHEN site_descriptor LIKE '%floor%' THEN 'Floor' ELSE 'Elevated' END AS site_category,
               touch = 'High' AS high_touch
        FROM {source}
        WHERE NOT regexp_matches(site_descriptor, 'bathroom|sink|toilet|nurse'))
)"""


COMMON = "swab_site unit site_category touch high_touch distance copies_max scv2_detected"
VARIANT_COLUMNS = {
    "spatial": f"redcap_id subject_covid_day subject_hosp_day {COMMON}",
    "spatial_days": f"redcap_id subject_covid_day subject_hosp_day subject_room_day total_study_day {COMMON}",
    "longitudinal": f"subject_room_id redcap_id subject_room_day subject_covid_day subject_hosp_day {COMMON}",
    "longitudinal_days": (
        f"subject_room_id redcap_id subject_room_day subject_covid_day subject_hosp_day total_study_day {COMMON}"
    ),
}
SPATIAL = analysis("spatial", "first_samples", VARIANT_COLUMNS["spatial"], False)
SPATIAL_DAYS = analysis("spatial_days", "first_samples", VARIANT_COLUMNS["spatial_days"], False)
LONG = analysis("longitudinal", "swabs", VARIANT_COLUMNS["longitudinal"], True)
LONG_DAYS = analysis("longitudinal_days", "swabs", VARIANT_COLUMNS["longitudinal_days"], True)
SEVERITY = (
    analysis("first_days", "first_samples", VARIANT_COLUMNS["longitudinal_days"], True)
    + ",\nseverity AS (SELECT f.*, g.covid_severity FROM first_days f LEFT JOIN graded g USING (redcap_id))"
)


def query(*parts: str) -> str:
    """``WITH`` of all parts but the last, which is the final select."""
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1].strip()


def rounded(column: str, alias: str | None = None, digits: int = 6) -> str:
    return f"round({column}, {digits}) + 0.0 AS {alias or column}"
