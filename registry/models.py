"""Queries over designs, fits, draws, predictions and checks."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from registry.base import add, on_both, on_swabs, tidy
from registry.sql_base import LONG_DAYS, SEVERITY, SPATIAL, SPATIAL_DAYS, SUBJECTS, SWABS, analysis, query, rounded
from registry.sql_fit import draws as draw_sql
from registry.sql_fit import inverse_normal, linear, lower, newton, normal_equations, normal_scores, patterns
from registry.tables import EVENT_DRAWS, event_draws, signif_sql
from tracelight import functions as C
from tracelight.functions import normal
from tracelight.operators import describe, grid, groups, intervals, joins, prep, reshape
from tracelight.plans import catalog, checks, densities, design, fits, mixing, pooling, rooms, strata
from tracelight.plans import draws as posterior
from tracelight.schemas import SEVERITY_LEVELS
from tracelight.sources import files, model_store, views
from tracelight.session import shared_path

DRAWS = 4000
THINNED = 1000

FLOOR = "site_category = 'Floor'"
TOUCH = "high_touch"
MID = "covid_severity = 'Only Nasal or Facemask Oxygen Support'"
STRONG = "covid_severity = 'Significant Oxygen Support'"
# SQL design terms of the bernoulli models with population-level effects.
TERMS = {
    "mvbinom_distance_fix_category_touch": ["distance", FLOOR, TOUCH],
    "mvbinom_time_fix_category_touch": ["subject_covid_day", FLOOR, TOUCH],
    "mvbinom_time_adjust_wave": [
        "subject_covid_day", FLOOR, "total_study_day", TOUCH, f"({FLOOR})::INTEGER * total_study_day"],
    "mvbinom_time_adjust_wave_severity": [
        "subject_covid_day", FLOOR, "total_study_day", TOUCH, MID, STRONG, f"({FLOOR})::INTEGER * total_study_day"],
    "mvbinom_time_adjust_wave_severity_site": [
        "subject_covid_day", FLOOR, "total_study_day", TOUCH, MID, STRONG, f"({FLOOR})::INTEGER * total_study_day",
        f"{FLOOR} AND {MID}", f"{FLOOR} AND {STRONG}"],
}
SOURCES = {
    "spatial_days": ("spatial_days", [SWABS, SPATIAL_DAYS]),
    "longitudinal_days": ("longitudinal_days", [SWABS, LONG_DAYS]),
    "severity": ("severity", [SWABS, SUBJECTS, SEVERITY]),
}
DISTANCE_MODEL = "mvbinom_distance_fix_category_touch"
TIME_MODEL = "mvbinom_time_fix_category_touch"
WAVE_MODEL = "mvbinom_time_adjust_wave"
SEVERITY_MODEL = "mvbinom_time_adjust_wave_severity"
SEVERITY_SITE_MODEL = "mvbinom_time_adjust_wave_severity_site"


def fit_parts(name: str, alias: str = "fit") -> list[str]:
    """CTEs up to the fitted coefficients of a bernoulli model."""
    model = catalog.MODELS[name]
    source, parts = SOURCES[model.variant]
    used = ["scv2_detected", *model.design.columns]
    return [*parts, patterns(f"{alias}_rows", source, TERMS[name], used), newton(alias, f"{alias}_rows", len(TERMS[name]) + 1)]


# ---------------------------------------------------------------- design and listings

def _design(swabs, subjects):
    table = prep.analysis_table(swabs, "severity", subjects)
    model = catalog.MODELS[SEVERITY_SITE_MODEL].design
    return design.design_columns(table.dropna(subset=model.columns), model, ["subject_room_id"])


add("g1_design_columns", on_both(_design), query(SWABS, SUBJECTS, SEVERITY, "SELECT subject_room_id, " + ", ".join(
    f"CAST({t} AS DOUBLE) AS x{i}" for i, t in enumerate(["1", *TERMS[SEVERITY_SITE_MODEL]])) + " FROM severity WHERE covid_severity IS NOT NULL"))
add("g2_observed_parameters", on_both(lambda s, p: design.observed_parameters(
    prep.analysis_table(s, "severity", p), ["subject_covid_day", "total_study_day"], ["site_category", "high_touch", "covid_severity"])),
    query(SWABS, SUBJECTS, SEVERITY, """levels AS (
      SELECT DISTINCT 'site_category' AS f, site_category AS v FROM severity UNION SELECT DISTINCT 'high_touch', CAST(high_touch AS VARCHAR) FROM severity
      UNION SELECT DISTINCT 'covid_severity', covid_severity FROM severity WHERE covid_severity IS NOT NULL)""",
    """SELECT 'Intercept' AS class, 'Intercept' AS coef UNION ALL SELECT 'b', 'subject_covid_day' UNION ALL SELECT 'b', 'total_study_day' UNION ALL
    SELECT 'b', f || replace(CASE v WHEN 'true' THEN 'TRUE' WHEN 'false' THEN 'FALSE' ELSE v END, ' ', '')
    FROM (SELECT * FROM levels QUALIFY row_number() OVER (PARTITION BY f ORDER BY v) > 1)"""))

ROOM_PRIORS = {"Intercept": "normal(0, 1)", "sd": "normal(0, 1)"}


def _prior_listing(swabs, subjects):
    ill = design.Design(("subject_covid_day", "site_category", "total_study_day", "high_touch", "covid_severity"))
    fixed = design.prior_listing(prep.analysis_table(swabs, "severity", subjects), ill, "bernoulli")
    room_model = catalog.MODELS["mvbinom_time_category_touch_mix_subject"]
    varying = design.prior_listing(
        prep.analysis_table(swabs, room_model.variant), room_model.design, "bernoulli", "subject_room_id", ROOM_PRIORS)
    return reshape.stack({"severity": fixed, "rooms": varying})


def _listing_sql(name, source, numeric, factors, where):
    """(model_name, class, coef) of the levels that occur."""
    levels = " UNION ALL ".join(f"SELECT DISTINCT '{f}' AS f, CAST({f} AS VARCHAR) AS v FROM {source} WHERE {where}" for f in factors)
    parts = [f"SELECT '{name}' AS m, 'Intercept' AS coef", *[f"SELECT '{name}', '{n}'" for n in numeric]]
    later = f"""SELECT '{name}', f || replace(CASE v WHEN 'true' THEN 'TRUE' WHEN 'false' THEN 'FALSE' ELSE v END, ' ', '')
      FROM (SELECT * FROM ({levels}) QUALIFY row_number() OVER (PARTITION BY f ORDER BY v) > 1)"""
    return f"{name}_names AS ({' UNION ALL '.join([*parts, later])})"


add("g2_prior_listing", on_both(_prior_listing), query(SWABS, SUBJECTS, LONG_DAYS, SEVERITY,
    _listing_sql("severity", "severity", ["subject_covid_day", "total_study_day"], ["site_category", "high_touch", "covid_severity"],
                 "covid_severity IS NOT NULL AND high_touch IS NOT NULL AND subject_covid_day IS NOT NULL AND total_study_day IS NOT NULL"),
    _listing_sql("rooms", "longitudinal_days", ["subject_covid_day"], ["site_category", "high_touch"], "high_touch IS NOT NULL AND subject_covid_day IS NOT NULL"), """
    SELECT 'severity' AS model_name, 'student_t(3, 0, 2.5)' AS prior, 'Intercept' AS class, '' AS coef, '' AS "group"
    UNION ALL SELECT 'severity', '', 'b', '', '' UNION ALL SELECT m, '', 'b', coef, '' FROM severity_names WHERE coef <> 'Intercept'
    UNION ALL SELECT 'rooms', 'normal(0, 1)', 'Intercept', '', '' UNION ALL SELECT 'rooms', 'normal(0, 1)', 'sd', '', g FROM (VALUES (''), ('subject_room_id')) t(g)
    UNION ALL SELECT m, 'normal(0, 1)', 'sd', coef, 'subject_room_id' FROM rooms_names
    UNION ALL SELECT 'rooms', 'lkj(1)', 'cor', '', g FROM (VALUES (''), ('subject_room_id')) t(g)"""))


def _patterns(swabs):
    table = prep.analysis_table(swabs, "longitudinal_days")
    return design.bernoulli_patterns(table, catalog.MODELS[TIME_MODEL].design)


add("g3_patterns", on_swabs(_patterns), query(SWABS, LONG_DAYS, patterns(
    "rows", "longitudinal_days", TERMS[TIME_MODEL], ["scv2_detected", "subject_covid_day", "site_category", "high_touch"]), "SELECT * FROM rows"))

# ---------------------------------------------------------------- fits

add("g4_cell_log_odds", on_swabs(lambda s: fits.cell_log_odds(
    prep.analysis_table(s, "longitudinal_days"), ["site_category", "high_touch"])),
    query(SWABS, LONG_DAYS, f"""SELECT site_category, high_touch, count(*) AS n, CAST(sum(CAST(scv2_detected AS INTEGER)) AS BIGINT) AS k,
    {rounded('ln(sum(CAST(scv2_detected AS INTEGER)) / (count(*) - sum(CAST(scv2_detected AS INTEGER))))', 'log_odds')}
    FROM longitudinal_days GROUP BY 1, 2"""))


def _fit_table(spark, folder, name):
    swabs, subjects = views.swabs(spark, folder), views.subjects(spark, folder)
    return tidy(catalog.fit_model(name, swabs, subjects).table(spark, name), 5)


def inverse_diagonal(p: int) -> list[str]:
    """SQL of the standard errors: column norms of the inverse Cholesky factor."""
    entries: dict[tuple[int, int], str] = {}
    for j in range(p):
        entries[j, j] = f"(1 / l{j}_{j})"
        for i in range(j + 1, p):
            total = " + ".join(f"l{i}_{k} * m{k}_{j}" for k in range(j, i))
            entries[i, j] = f"(-({total}) / l{i}_{i})"
    return entries


def with_errors(fit: str, p: int) -> str:
    """Nested select adding ``m<i>_<j>``, the inverse of the Cholesky factor."""
    entries = inverse_diagonal(p)
    sql = f"SELECT * FROM {fit}"
    for i in range(p):
        row = ", ".join(f"{entries[i, j]} AS m{i}_{j}" for j in range(i + 1))
        sql = f"SELECT *, {row} FROM ({sql})"
    return sql


for _name in TERMS:
    _p = len(TERMS[_name]) + 1
    _rows = " UNION ALL ".join(
        f"SELECT '{_name}' AS model_name, '{parameter}' AS param, {rounded(f'b{i}', 'estimate', 5)}, "
        + rounded("sqrt(" + " + ".join(f"m{k}_{i} * m{k}_{i}" for k in range(i, _p)) + ")", "est_error", 5)
        + " FROM errors"
        for i, parameter in enumerate(catalog.MODELS[_name].design.parameters)
    )
    add(f"g4_{_name}", partial(_fit_table, name=_name),
        query(*fit_parts(_name), f"errors AS MATERIALIZED ({with_errors('fit', _p)})", _rows))


def _lines(swabs, axis, keys):
    table = prep.analysis_table(swabs, "spatial" if axis == "distance" else "longitudinal")
    return fits.simple_lines(table, axis, F.log10("copies_max"), keys)


LONG_AXIS = analysis("longitudinal", "swabs", "subject_room_id redcap_id subject_room_day subject_covid_day subject_hosp_day swab_site unit site_category touch high_touch distance copies_max scv2_detected", True)
for _axis, _keys in (("distance", ["site_category"]), ("distance", ["site_category", "high_touch"]),
                     ("subject_covid_day", ["site_category"]), ("subject_covid_day", ["site_category", "high_touch"])):
    _table, _cte = ("spatial", SPATIAL) if _axis == "distance" else ("longitudinal", LONG_AXIS)
    _short = ("distance" if _axis == "distance" else "time") + ("_touch" if len(_keys) == 2 else "")
    add(f"g5_lines_{_short}", on_swabs(partial(_lines, axis=_axis, keys=_keys)), query(SWABS, _cte, f"""
        SELECT {', '.join(_keys)}, count(*) AS n, {rounded('regr_intercept(y, x)', 'intercept')}, {rounded('regr_slope(y, x)', 'slope')},
        {rounded('sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2))', 'sigma')}
        FROM (SELECT *, log10(copies_max) AS y, CAST({_axis} AS DOUBLE) AS x FROM {_table} WHERE copies_max IS NOT NULL) GROUP BY {', '.join(_keys)}"""))
    add(f"g6_hurdle_{_short}", on_swabs(lambda s, a=_axis, k=tuple(_keys), t=_table: fits.hurdle_lines(
        prep.analysis_table(s, t), a, list(k))), query(SWABS, _cte, f"""
        SELECT {', '.join(_keys)}, {rounded('avg(CAST(copies_max IS NULL AS INTEGER))', 'hu')},
        {rounded('regr_intercept(y, x)', 'intercept')}, {rounded('regr_slope(y, x)', 'slope')},
        {rounded('sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(y) - 2))', 'sigma')}
        FROM (SELECT *, ln(copies_max) AS y, CASE WHEN copies_max IS NOT NULL THEN CAST({_axis} AS DOUBLE) END AS x FROM {_table})
        GROUP BY {', '.join(_keys)}"""))

HURDLE_MODEL = "mvhurdle_distance_fix_category_touch"
HURDLE_TERMS = ["distance", FLOOR, TOUCH]
HURDLE_FIT = [SWABS, SPATIAL, f"""
hurdle_rows AS (SELECT ln(copies_max) AS y, {', '.join(f'CAST({t} AS DOUBLE) AS x{i}' for i, t in enumerate(['1', *HURDLE_TERMS]))}
  FROM spatial WHERE copies_max > 0),
hurdle_share AS (SELECT avg(CAST(copies_max IS NULL AS INTEGER)) AS hu, CAST(count(*) AS DOUBLE) AS rows FROM spatial)""",
    normal_equations("fit", "hurdle_rows", 4)]
add("g6_hurdle_fixed", partial(_fit_table, name=HURDLE_MODEL), query(
    *HURDLE_FIT, f"errors AS MATERIALIZED ({with_errors('fit', 4)})", " UNION ALL ".join(
        f"SELECT '{HURDLE_MODEL}' AS model_name, '{parameter}' AS param, {rounded(f'b{i}', 'estimate', 5)}, "
        + rounded("sigma * sqrt(" + " + ".join(f"m{k}_{i} * m{k}_{i}" for k in range(i, 4)) + ")", "est_error", 5) + " FROM errors"
        for i, parameter in enumerate(catalog.MODELS[HURDLE_MODEL].design.parameters)
    ) + f""" UNION ALL SELECT '{HURDLE_MODEL}', 'sigma', {rounded('sigma', 'estimate', 5)}, NULL FROM errors
    UNION ALL SELECT '{HURDLE_MODEL}', 'hu', {rounded('hu', 'estimate', 5)}, NULL FROM hurdle_share"""))


def _strata(swabs, axis, variant):
    table = prep.analysis_table(swabs, variant)
    found = fits.fit_bernoulli(table, design.Design((axis,)), keys=["site_category"])
    rows = [(k[0], float(f.beta[0]), float(f.beta[1])) for k, f in sorted(found.items())]
    return swabs.sparkSession.createDataFrame(rows, "site_category string, intercept double, slope double")


add("g7_stratum_fits", on_swabs(partial(_strata, axis="subject_covid_day", variant="longitudinal_days"), 5), query(
    SWABS, LONG_DAYS, patterns("rows", "longitudinal_days", ["subject_covid_day"], ["scv2_detected", "subject_covid_day"], "site_category"),
    newton("fit", "rows", 2, stratum=True),
    f"SELECT stratum AS site_category, {rounded('b0', 'intercept', 5)}, {rounded('b1', 'slope', 5)} FROM fit"))


def _pooled(spark, folder, name):
    pooled = catalog.fit_model(name, views.swabs(spark, folder))
    return tidy(pooled.table(spark, name, catalog.MODELS[name].design.parameters), 4)


for _name, _model in catalog.MODELS.items():
    if _model.strata:
        add(f"g7_{_name}", partial(_pooled, name=_name))


def _rooms(spark, folder, name):
    fit = catalog.fit_model(name, views.swabs(spark, folder))
    return tidy(fit.effects.select(fit.group, *[F.col(f"u{i}") for i in range(len(fit.design.parameters))]), 4)


for _name, _model in catalog.MODELS.items():
    if _model.room_level:
        add(f"g8_{_name}", partial(_rooms, name=_name))

# ---------------------------------------------------------------- draws and predictions


def model_draws(spark, folder, name, count=DRAWS):
    swabs, subjects = views.swabs(spark, folder), views.subjects(spark, folder)
    table = catalog.model_table(name, swabs, subjects)
    fit = catalog.fit_table(name, table)
    return table, fit, posterior.laplace_draws(spark, fit, count)


def draw_parts(name, count=DRAWS, alias="fit"):
    p = len(TERMS[name]) + 1
    return [*fit_parts(name, alias), normal_scores(count, p), draw_sql("draws", alias, p, count)]


def _draws(spark, folder):
    _, fit, wide = model_draws(spark, folder, DISTANCE_MODEL)
    return tidy(wide, 4)


add("g9_draws", _draws, query(*draw_parts(DISTANCE_MODEL), "SELECT draw, " + ", ".join(rounded(f"b{i}", digits=4) for i in range(4)) + " FROM draws"))


def _weights(spark, folder):
    table, fit, wide = model_draws(spark, folder, DISTANCE_MODEL)
    rows = design.bernoulli_patterns(table, fit.design)
    weights, size = posterior.importance_weights(rows, wide, fit)
    picked = posterior.resample(wide, weights, DRAWS)
    return tidy(picked.agg(*[F.avg(f"b{i}").alias(f"b{i}") for i in range(4)], F.count(F.lit(1)).alias("draws"),
                           F.lit(size).alias("effective_size")), 3)


add("g9_resampled", _weights)

GRID7 = """
axes AS (SELECT min(distance) AS lo, max(distance) AS hi FROM spatial_days),
grid AS (SELECT lo + i * (hi - lo) / 99 AS distance, site_category, high_touch FROM axes, range(100) r(i),
  (SELECT DISTINCT site_category FROM spatial_days), (SELECT DISTINCT high_touch FROM spatial_days)
  WHERE NOT (high_touch AND site_category = 'Floor'))"""
EPRED7 = f"epred AS MATERIALIZED (SELECT distance, site_category, high_touch, draw, 1 / (1 + exp(-({linear(4, TERMS[DISTANCE_MODEL])}))) AS epred FROM grid, draws)"


def _points(spark, folder, name, even, levels, count):
    table, fit, wide = model_draws(spark, folder, name, count)
    return grid.prediction_grid(prep.model_frame(table, ["scv2_detected", *fit.design.columns]), even or {"distance": 100}, levels), fit, wide


def _epred(spark, folder, name=DISTANCE_MODEL, even=None, levels=("site_category", "high_touch"), count=DRAWS):
    points, fit, wide = _points(spark, folder, name, even, levels, count)
    return posterior.expected_draws(points, wide, fit.design, count)


def _ribbon(spark, folder, name=DISTANCE_MODEL, even=None, by=("distance", "site_category", "high_touch"), count=DRAWS):
    points, fit, wide = _points(spark, folder, name, even, ("site_category", "high_touch"), count)
    return posterior.expected_quantiles(points, wide, fit.design, count, by, intervals.RIBBON)


add("p1_expected_draws", lambda spark, folder: tidy(_epred(spark, folder), 5), query(
    *draw_parts(DISTANCE_MODEL), GRID7, EPRED7, f"SELECT {rounded('distance', digits=5)}, site_category, high_touch, draw, {rounded('epred', digits=5)} FROM epred"))
add("p2_thinned_draws", lambda spark, folder: tidy(posterior.thin(model_draws(spark, folder, DISTANCE_MODEL)[2], THINNED), 4), query(
    *draw_parts(DISTANCE_MODEL), "SELECT draw, " + ", ".join(rounded(f"b{i}", digits=4) for i in range(4)) + f" FROM draws WHERE draw < {THINNED}"))
RIBBON_SQL = ", ".join(rounded(f"quantile_cont(epred, {p})", n, 5) for n, p in intervals.RIBBON.items())
add("p3_ribbon", lambda spark, folder: tidy(_ribbon(spark, folder), 5), query(
    *draw_parts(DISTANCE_MODEL), GRID7, EPRED7, f"SELECT {rounded('distance', digits=5)}, site_category, high_touch, {RIBBON_SQL} FROM epred GROUP BY epred.distance, site_category, high_touch"))

GRID21 = """
axes AS (SELECT min(subject_covid_day) AS lo, max(subject_covid_day) AS hi, min(total_study_day) AS wlo, max(total_study_day) AS whi FROM longitudinal_days),
grid AS (SELECT lo + i * (hi - lo) / 9.0 AS subject_covid_day, wlo + j * (whi - wlo) / 9.0 AS total_study_day, site_category, high_touch
  FROM axes, range(10) r(i), range(10) t(j), (SELECT DISTINCT site_category FROM longitudinal_days), (SELECT DISTINCT high_touch FROM longitudinal_days)
  WHERE NOT (high_touch AND site_category = 'Floor'))"""
EPRED21 = f"epred AS MATERIALIZED (SELECT grid.*, draw, 1 / (1 + exp(-({linear(6, TERMS[WAVE_MODEL])}))) AS epred FROM grid, draws)"
WAVE_EVEN = {"subject_covid_day": 10, "total_study_day": 10}
add("p3_ribbon_pooled", lambda spark, folder: tidy(_ribbon(
    spark, folder, WAVE_MODEL, WAVE_EVEN, ("total_study_day", "site_category", "high_touch")), 5), query(
    *draw_parts(WAVE_MODEL), GRID21, EPRED21, f"""SELECT {rounded('total_study_day', digits=5)}, site_category, high_touch, {RIBBON_SQL}
    FROM epred GROUP BY epred.total_study_day, site_category, high_touch"""))

GRID22 = """
axes AS (SELECT min(subject_covid_day) AS lo, max(subject_covid_day) AS hi, min(total_study_day) AS wlo, max(total_study_day) AS whi
  FROM severity WHERE covid_severity IS NOT NULL),
grid AS (SELECT lo + i * (hi - lo) / 9.0 AS subject_covid_day, wlo + j * (whi - wlo) / 9.0 AS total_study_day, site_category, high_touch, covid_severity
  FROM axes, range(10) r(i), range(10) t(j), (SELECT DISTINCT site_category FROM severity), (SELECT DISTINCT high_touch FROM severity),
  (SELECT DISTINCT covid_severity FROM severity WHERE covid_severity IS NOT NULL)
  WHERE NOT (high_touch AND site_category = 'Floor'))"""


def _hdi(spark, folder, name):
    epred = _epred(spark, folder, name, WAVE_EVEN, ("site_category", "high_touch", "covid_severity"), THINNED)
    labelled = prep.with_contact_label(epred).select(
        F.concat("site_category", F.lit(" "), "high_touch").alias("site_category_touch"), "covid_severity", "draw", "epred")
    best = intervals.shortest_interval(labelled, ["site_category_touch", "covid_severity"], tie=["draw"])
    return tidy(best.withColumn("covid_severity", F.regexp_replace("covid_severity", "Facemask Oxygen", "Facemask<br>Oxygen")), 5)


for _name, _label in ((SEVERITY_MODEL, "severity"), (SEVERITY_SITE_MODEL, "severity_site")):
    _p = len(TERMS[_name]) + 1
    add(f"p4_shortest_interval_{_label}", partial(_hdi, name=_name), query(*draw_parts(_name, THINNED), GRID22, f"""
    epred AS MATERIALIZED (SELECT site_category || CASE WHEN high_touch THEN ' High Touch' ELSE ' Low Touch' END AS site_category_touch, covid_severity,
      1 / (1 + exp(-({linear(_p, TERMS[_name])}))) AS epred FROM grid, draws),
    spans AS (SELECT site_category_touch, covid_severity, epred AS lower, lead(epred, CAST(ceil(0.95 * 100 * {THINNED}) AS INTEGER) - 1)
      OVER (PARTITION BY site_category_touch, covid_severity ORDER BY epred) AS upper FROM epred),
    best AS (SELECT * FROM spans WHERE upper IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY site_category_touch, covid_severity ORDER BY upper - lower, lower) = 1)""", f"""
    SELECT site_category_touch, replace(covid_severity, 'Facemask Oxygen', 'Facemask<br>Oxygen') AS covid_severity,
    {rounded('median', 'epred', 5)}, {rounded('lower', digits=5)}, {rounded('upper', digits=5)}
    FROM best JOIN (SELECT site_category_touch, covid_severity, median(epred) AS median FROM epred GROUP BY 1, 2) USING (site_category_touch, covid_severity)"""))
# The shortest run of sorted values is also checked on its own, on the copies of each unit and site.
add("w7_shortest_run", on_swabs(lambda s: intervals.shortest_interval(s, ["unit", "swab_site"], "copies_max", 0.9, ["event_id"])), query(SWABS, """
    sized AS (SELECT unit, swab_site, copies_max AS x, row_number() OVER w AS r, count(*) OVER (PARTITION BY unit, swab_site) AS n
      FROM swabs WHERE copies_max IS NOT NULL WINDOW w AS (PARTITION BY unit, swab_site ORDER BY copies_max)),
    pairs AS (SELECT a.unit, a.swab_site, a.x AS lower, b.x AS upper FROM sized a JOIN sized b ON a.unit = b.unit AND a.swab_site = b.swab_site
      AND b.r = a.r + CAST(ceil(round(0.9 * a.n, 9)) AS BIGINT) - 1
      QUALIFY row_number() OVER (PARTITION BY a.unit, a.swab_site ORDER BY b.x - a.x, a.x) = 1)""", f"""
    SELECT unit, swab_site, {rounded('m', 'copies_max')}, {rounded('lower')}, {rounded('upper')} FROM pairs
    JOIN (SELECT unit, swab_site, median(copies_max) AS m FROM swabs GROUP BY 1, 2) USING (unit, swab_site)"""))

# Regions of highest density of each unit's quantities: several modes, several intervals.
REGION_POINTS, REGION_STEP = 129, 1 / 128
add("p4_density_regions", on_swabs(lambda s: densities.density_regions(
    s.select("unit", F.log10("copies_max").alias("quantity")), ["unit"], "quantity", 0.8)), query(SWABS, f"""
    ends AS (SELECT unit, min(log10(copies_max)) AS low, max(log10(copies_max)) AS high FROM swabs GROUP BY 1),
    scaled AS (SELECT unit, CASE WHEN high > low THEN (log10(copies_max) - (low - 0.1 * (high - low))) / (1.2 * (high - low)) ELSE 0.5 END AS x
      FROM swabs JOIN ends USING (unit) WHERE copies_max IS NOT NULL),
    spots AS (SELECT unit, least(greatest(x / {REGION_STEP}, 0), 128) AS spot FROM scaled),
    shared AS (SELECT unit, spot, least(floor(spot), 127) AS b FROM spots),
    binned AS MATERIALIZED (SELECT unit, bin, sum(w) AS weight, any_value(CAST(bin * {REGION_STEP} AS DOUBLE)) AS x FROM
      (SELECT unit, b AS bin, b + 1 - spot AS w FROM shared UNION ALL SELECT unit, b + 1, spot - b FROM shared) GROUP BY 1, 2),
    broad AS (SELECT unit, sum(weight) AS n, greatest(0.9 * sqrt(greatest(sum(weight * x * x) / sum(weight) - (sum(weight * x) / sum(weight)) ** 2, 0))
      * sum(weight) ** (-0.2::DOUBLE), {REGION_STEP}) AS h FROM binned GROUP BY 1),
    raw AS (SELECT unit, i, sum(weight * exp(-0.5 * ((i * {REGION_STEP} - x) / h) ** 2) / (h * n)) AS d,
      coalesce(sum(CASE WHEN bin = i THEN weight END), 0) AS w FROM broad CROSS JOIN range(129) g(i) JOIN binned USING (unit) GROUP BY 1, 2),
    rel AS (SELECT unit, i, w, round(d / max(d) OVER (PARTITION BY unit), 12) AS d FROM raw),
    ranked AS (SELECT *, sum(w) OVER (PARTITION BY unit ORDER BY d DESC, i) - w AS before, sum(w) OVER (PARTITION BY unit) AS whole,
      lag(d) OVER (PARTITION BY unit ORDER BY i) AS l, lead(d) OVER (PARTITION BY unit ORDER BY i) AS r FROM rel),
    cuts AS (SELECT *, min(CASE WHEN before < whole * (0.8 - 1e-9) THEN d END) OVER (PARTITION BY unit) AS cut FROM ranked),
    kept AS (SELECT *, i - row_number() OVER (PARTITION BY unit ORDER BY i) AS run FROM cuts WHERE d >= cut),
    runs AS (SELECT unit, run, min(CASE WHEN l < cut THEN i * {REGION_STEP} - {REGION_STEP} * (d - cut) / (d - l) ELSE i * {REGION_STEP} END) AS lower,
      max(CASE WHEN r < cut THEN i * {REGION_STEP} + {REGION_STEP} * (d - cut) / (d - r) ELSE i * {REGION_STEP} END) AS upper, sum(w) / any_value(whole) AS share FROM kept GROUP BY 1, 2)""", f"""
    SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY run) AS region, {rounded('low - 0.1 * (high - low) + lower * 1.2 * (high - low)', 'lower')},
    {rounded('low - 0.1 * (high - low) + upper * 1.2 * (high - low)', 'upper')}, {rounded('share')} FROM runs JOIN ends USING (unit)"""))

HURDLE_DRAWS = [*HURDLE_FIT, normal_scores(DRAWS, 6), draw_sql("lines", "fit", 4, DRAWS, "sigma * "), """
draws AS MATERIALIZED (SELECT lines.*, fit.sigma * exp(z4 / sqrt(2 * greatest(rows * (1 - hu) - 4, 1))) AS sigma,
  1 / (1 + exp(-(ln(hu / (1 - hu)) + z5 / sqrt(rows * hu * (1 - hu))))) AS hu
  FROM lines JOIN scores USING (draw), fit, hurdle_share)"""]


def _hurdle_ribbon(spark, folder):
    table, fit, wide = model_draws(spark, folder, HURDLE_MODEL)
    points = grid.prediction_grid(table.dropna(subset=fit.design.columns), {"distance": 100}, ["site_category", "high_touch"])
    found = posterior.expected_quantiles(
        points, wide, fit.design, DRAWS, ["distance", "site_category", "high_touch"], intervals.RIBBON, "hurdle_lognormal")
    return tidy(found, 3)


add("p3_ribbon_hurdle", _hurdle_ribbon, query(*HURDLE_DRAWS, GRID7.replace("spatial_days", "spatial"), f"""
epred AS MATERIALIZED (SELECT distance, site_category, high_touch, draw, (1 - hu) * exp({linear(4, HURDLE_TERMS)} + sigma * sigma / 2) AS epred FROM grid, draws)""",
    f"""SELECT {rounded('distance', digits=3)}, site_category, high_touch,
    {', '.join(rounded(f'quantile_cont(epred, {p})', n, 3) for n, p in intervals.RIBBON.items())} FROM epred GROUP BY epred.distance, site_category, high_touch"""))


def _strata_ribbon(spark, folder, name):
    return tidy(strata.strata_ribbon(name, views.swabs(spark, folder), DRAWS), 3)


for _name, _model in catalog.MODELS.items():
    if _model.strata:
        add(f"p3_ribbon_{_name}", partial(_strata_ribbon, name=_name))


def _room_fit(spark, folder, name="mvbinom_time_category_touch_mix_subject", points=40):
    swabs = views.swabs(spark, folder)
    table = catalog.model_table(name, swabs)
    fit = catalog.fit_model(name, swabs)
    axis = fit.design.columns[0]
    frame = prep.model_frame(table, [fit.group, *fit.design.columns])
    cells = grid.prediction_grid(frame, {axis: points}, ["site_category", "high_touch"], entity=fit.group)
    return swabs, fit, cells, axis


def _room_medians(spark, folder):
    _, fit, cells, axis = _room_fit(spark, folder)
    return tidy(rooms.room_medians(fit, cells, THINNED).select(fit.group, axis, "site_category", "high_touch", "epred"), 4)


add("p5_room_curves", _room_medians)
# The same operator on given values: median quantity per room and site, SQL-checked.
add("p5_median_curve", on_swabs(lambda s: intervals.median_curve(
    s.where("copies_max IS NOT NULL"), ["subject_room_id", "swab_site"], "copies_max")),
    query(SWABS, f"SELECT subject_room_id, swab_site, {rounded('median(copies_max)', 'copies_max')} FROM swabs WHERE copies_max IS NOT NULL GROUP BY 1, 2"))


def _room_points(spark, folder):
    swabs, fit, cells, axis = _room_fit(spark, folder, "mvbinom_distance_category_touch_mix_subject", 30)
    nearest = prep.touched_or_floor(prep.at_minimum(cells, axis))
    medians = rooms.room_medians(fit, nearest, THINNED)
    return tidy(reshape.floor_against_touched(medians, swabs), 4)


add("p6_floor_against_touched", _room_points)

SUMMARY = ", ".join([
    rounded("avg(value)", '"Estimate"', 4), rounded("stddev_samp(value)", '"Est_Error"', 4),
    rounded("quantile_cont(value, 0.025)", '"Q2_5"', 4), rounded("quantile_cont(value, 0.975)", '"Q97_5"', 4)])


def _long(name, fit_alias="draws"):
    return " UNION ALL ".join(
        f"SELECT '{name}' AS model_name, '{p}' AS param, b{i} AS value FROM {fit_alias}"
        for i, p in enumerate(catalog.MODELS[name].design.parameters))


def _summaries(spark, folder, names):
    tables = []
    for name in names:
        _, fit, wide = model_draws(spark, folder, name)
        tables.append(posterior.long_draws(wide, fit.design, name))
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table)
    return posterior.parameter_summary(stacked)


add("p7_parameter_summary", lambda spark, folder: tidy(_summaries(spark, folder, [WAVE_MODEL]), 4), query(
    *draw_parts(WAVE_MODEL), f"long AS ({_long(WAVE_MODEL)})", f"SELECT model_name, param, {SUMMARY} FROM long GROUP BY 1, 2"))


def _odds(spark, folder):
    stacked = posterior.with_odds(_summaries(spark, folder, [DISTANCE_MODEL, SEVERITY_MODEL]))
    floor = posterior.lookup_parameter(stacked, DISTANCE_MODEL, "^b_site_categoryFloor$")
    strong = posterior.lookup_parameter(stacked, SEVERITY_MODEL, "SignificantOxygen")
    picked = floor.unionByName(strong)
    return tidy(picked.select("model_name", "param", *[
        C.significant(F.col(c), 3).alias(c) for c in ("Estimate_exp", "Q2_5_exp", "Q97_5_exp")]), 4)


def _two_fits():
    first, second = fit_parts(DISTANCE_MODEL, "near"), fit_parts(SEVERITY_MODEL, "ill")
    p, q = len(TERMS[DISTANCE_MODEL]) + 1, len(TERMS[SEVERITY_MODEL]) + 1
    return [*first, *[x for x in second if x != SWABS], normal_scores(DRAWS, q),
            draw_sql("near_draws", "near", p, DRAWS), draw_sql("ill_draws", "ill", q, DRAWS)]


add("p8_odds_lookup", _odds, query(*_two_fits(), f"""
long AS ({_long(DISTANCE_MODEL, 'near_draws')} UNION ALL {_long(SEVERITY_MODEL, 'ill_draws')}),
odds AS (SELECT model_name, param, exp(avg(value)) AS e, exp(quantile_cont(value, 0.025)) AS lo, exp(quantile_cont(value, 0.975)) AS hi FROM long GROUP BY 1, 2)""",
    f"""SELECT model_name, param, {rounded(signif_sql('e', 3), '"Estimate_exp"', 4)}, {rounded(signif_sql('lo', 3), '"Q2_5_exp"', 4)},
    {rounded(signif_sql('hi', 3), '"Q97_5_exp"', 4)} FROM odds
    WHERE (model_name = '{DISTANCE_MODEL}' AND param = 'b_site_categoryFloor') OR (model_name = '{SEVERITY_MODEL}' AND param LIKE '%SignificantOxygen%')"""))

# The names under which the five models are printed.
STACKED = {
    DISTANCE_MODEL: "Distance Fixed", TIME_MODEL: "Time Fixed", "mvbinom_time_category_touch_mix_subject": "Time Subject Random",
    WAVE_MODEL: "Time Pandemic Wave Adjusted", SEVERITY_MODEL: "COVID-19 Severity",
}
FIXED = [name for name in STACKED if not catalog.MODELS[name].room_level]
SUMMARY_COLUMNS = ["Estimate", "Est_Error", "Q2_5", "Q97_5"]
_SUMMARY_PARTS = """avg(value) AS "Estimate", stddev_samp(value) AS "Est_Error", quantile_cont(value, 0.025) AS "Q2_5", quantile_cont(value, 0.975) AS "Q97_5\""""


def _named(frame):
    names = F.create_map(*[F.lit(x) for pair in STACKED.items() for x in pair])
    return frame.withColumn("model_name", F.element_at(names, F.col("model_name")))


def _room_parameters(spark, folder, name="mvbinom_time_category_touch_mix_subject"):
    """Long draws of a room-level model's population parameters, resampled by their weights."""
    fit = catalog.fit_model(name, views.swabs(spark, folder))
    draws, weights, _ = rooms.parameter_draws(fit, DRAWS)
    picked = posterior.resample(draws, weights, DRAWS)
    return posterior.long_draws(picked, fit.design, name)


def _all_summaries(spark, folder):
    fixed = _summaries(spark, folder, FIXED)
    return _named(fixed.unionByName(posterior.parameter_summary(_room_parameters(spark, folder))))


def _fixed_fits():
    parts, named = [], {name: f"f{i}" for i, name in enumerate(FIXED)}
    for name, alias in named.items():
        parts += fit_parts(name, alias)
    parts.append(normal_scores(DRAWS, max(len(TERMS[n]) for n in FIXED) + 1))
    parts += [draw_sql(f"{alias}_draws", alias, len(TERMS[name]) + 1, DRAWS) for name, alias in named.items()]
    long = " UNION ALL ".join(_long(name, f"{alias}_draws").replace(f"'{name}' AS", f"'{STACKED[name]}' AS") for name, alias in named.items())
    return [*dict.fromkeys(parts), f"long AS ({long})"]


add("p7_fixed_models", lambda spark, folder: tidy(_named(_summaries(spark, folder, FIXED)), 4),
    query(*_fixed_fits(), f"SELECT model_name, param, {SUMMARY} FROM long GROUP BY 1, 2"))
add("p8_fixed_models", lambda spark, folder: tidy(posterior.with_odds(_named(_summaries(spark, folder, FIXED))), 3),
    query(*_fixed_fits(), f"parts AS (SELECT model_name, param, {_SUMMARY_PARTS} FROM long GROUP BY 1, 2)", "SELECT model_name, param, " + ", ".join(
        rounded(f'"{c}"', digits=3) + ", " + rounded(f'exp("{c}")', f'"{c}_exp"', 3) for c in SUMMARY_COLUMNS) + " FROM parts"))
# The room-level model among the others, with exponentiated copies of all numbers.
add("g9_stacked_parameters", lambda spark, folder: tidy(posterior.with_odds(_all_summaries(spark, folder)), 4))

# ---------------------------------------------------------------- checks

add("p9_chain_convergence", lambda spark, folder: tidy(checks.chain_convergence(event_draws(spark, folder))), query(EVENT_DRAWS, """
chains AS (SELECT model_name, param, chain, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM event_draws GROUP BY 1, 2, 3),
ratios AS (SELECT model_name, param, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS rhat FROM chains GROUP BY 1, 2)""",
    f"SELECT model_name, param, {rounded('rhat')}, rhat < 1.1 AS converged FROM ratios"))
add("p9_split_convergence", lambda spark, folder: tidy(checks.chain_convergence(event_draws(spark, folder), split=True)), query(EVENT_DRAWS, """
middles AS (SELECT model_name, chain, (min(iteration) + max(iteration)) / 2 AS middle FROM event_draws GROUP BY 1, 2),
chains AS (SELECT model_name, param, chain, iteration > middle AS half, avg(value) AS m, var_samp(value) AS v, count(*) AS n
  FROM event_draws JOIN middles USING (model_name, chain) GROUP BY 1, 2, 3, 4),
ratios AS (SELECT model_name, param, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS rhat FROM chains GROUP BY 1, 2)""",
    f"SELECT model_name, param, {rounded('rhat')}, rhat < 1.1 AS converged FROM ratios"))

# Average ranks over all chains, and the split-chain ratio of their normal scores (plain and folded).
RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY model_name, param ORDER BY value)
  + (count(*) OVER (PARTITION BY model_name, param, value) - 1) / 2 AS rank, count(*) OVER (PARTITION BY model_name, param) AS n FROM event_draws)"""
add("p9_average_ranks", lambda spark, folder: tidy(mixing.average_ranks(
    event_draws(spark, folder), ["model_name", "param"], "value").select("model_name", "chain", "iteration", "param", "rank")),
    query(EVENT_DRAWS, RANKED, f"SELECT model_name, chain, iteration, param, {rounded('rank')} FROM ranked"))


def _score_sql(source, value, name):
    ranks = f"rank() OVER (PARTITION BY model_name, param ORDER BY {value}) + (count(*) OVER (PARTITION BY model_name, param, {value}) - 1) / 2"
    share = f"({ranks} - 0.375) / (count(*) OVER (PARTITION BY model_name, param) + 0.25)"
    return f"SELECT *, {inverse_normal('u')} AS {name} FROM (SELECT * EXCLUDE (u), {share} AS u FROM (SELECT *, 0 AS u FROM ({source})))"


def _ratio_sql(value):
    return f"""SELECT model_name, param, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS rhat FROM
      (SELECT model_name, param, chain, half, avg({value}) AS m, var_samp({value}) AS v, count(*) AS n FROM scored GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"""


add("p9_rank_convergence", lambda spark, folder: tidy(mixing.rank_convergence(event_draws(spark, folder))), query(EVENT_DRAWS, f"""
middles AS (SELECT model_name, chain, (min(iteration) + max(iteration)) / 2 AS middle FROM event_draws GROUP BY 1, 2),
halves AS (SELECT d.*, iteration > middle AS half FROM event_draws d JOIN middles USING (model_name, chain)),
away AS (SELECT *, abs(value - median(value) OVER (PARTITION BY model_name, param)) AS away FROM halves),
scored AS MATERIALIZED ({_score_sql(_score_sql("SELECT * FROM away", "value", "z"), "away", "folded")}),
ratios AS (SELECT model_name, param, max(rhat) AS rhat FROM ({_ratio_sql("z")} UNION ALL {_ratio_sql("folded")}) GROUP BY 1, 2)""",
    f"SELECT model_name, param, {rounded('rhat')}, rhat < 1.1 AS converged FROM ratios"))


def _size_sql(value):
    """CTEs of the effective size of a column of ``scored``, by lagged products, ending in ``<value>_size``."""
    v = value
    return f"""
{v}_rows AS MATERIALIZED (SELECT model_name, param, chain, half, {v} - avg({v}) OVER (PARTITION BY model_name, param, chain, half) AS x,
  row_number() OVER (PARTITION BY model_name, param, chain, half ORDER BY iteration) AS i, count(*) OVER (PARTITION BY model_name, param, chain, half) AS n FROM scored),
{v}_chains AS (SELECT model_name, param, chain, half, avg({v}) AS m, var_samp({v}) AS v, count(*) AS n FROM scored GROUP BY 1, 2, 3, 4),
{v}_stats AS (SELECT model_name, param, avg(v) AS w, (avg(n) - 1) / avg(n) * avg(v) + coalesce(var_samp(m), 0) AS t, sum(n) AS draws, min(n) AS least FROM {v}_chains GROUP BY 1, 2),
{v}_lagged AS (SELECT a.model_name, a.param, b.i - a.i AS lag, sum(a.x * b.x / a.n) AS s FROM {v}_rows a JOIN {v}_rows b
  ON a.model_name = b.model_name AND a.param = b.param AND a.chain = b.chain AND a.half = b.half AND b.i >= a.i GROUP BY 1, 2, 3),
{v}_counts AS (SELECT model_name, param, count(*) AS chains FROM {v}_chains GROUP BY 1, 2),
{v}_rho AS (SELECT model_name, param, lag, CASE WHEN lag = 0 THEN 1 ELSE 1 - (w - s / chains) / nullif(t, 0) END AS rho
  FROM {v}_lagged JOIN {v}_stats USING (model_name, param) JOIN {v}_counts USING (model_name, param) WHERE lag < least),
{v}_pairs AS (SELECT model_name, param, lag // 2 AS k, sum(rho) AS pair FROM {v}_rho GROUP BY 1, 2, 3 HAVING count(*) = 2),
{v}_kept AS (SELECT *, min(pair) OVER (PARTITION BY model_name, param ORDER BY k) AS low FROM {v}_pairs),
{v}_time AS (SELECT model_name, param, 2 * sum(low) - 1 AS took FROM {v}_kept WHERE low > 0 GROUP BY 1, 2),
{v}_size AS (SELECT model_name, param, CASE WHEN t > 0 THEN draws / greatest(coalesce(took, 0), 1 / log10(draws)) END AS size
  FROM {v}_stats LEFT JOIN {v}_time USING (model_name, param))"""


add("p9_effective_sizes", lambda spark, folder: tidy(mixing.effective_sizes(event_draws(spark, folder)), 3), query(EVENT_DRAWS, f"""
middles AS (SELECT model_name, chain, (min(iteration) + max(iteration)) / 2 AS middle FROM event_draws GROUP BY 1, 2),
halves AS (SELECT d.*, iteration > middle AS half FROM event_draws d JOIN middles USING (model_name, chain)),
limits AS (SELECT model_name, param, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM event_draws GROUP BY 1, 2),
flagged AS (SELECT h.*, CAST(value <= lo AS DOUBLE) AS below, CAST(value <= hi AS DOUBLE) AS upto FROM halves h JOIN limits USING (model_name, param)),
scored AS MATERIALIZED ({_score_sql("SELECT * FROM flagged", "value", "z")})""", *[_size_sql(v) for v in ("z", "below", "upto")], f"""
SELECT model_name, param, {rounded('z_size.size', 'ess_bulk', 3)}, {rounded('least(below_size.size, upto_size.size)', 'ess_tail', 3)}
FROM z_size JOIN below_size USING (model_name, param) JOIN upto_size USING (model_name, param)"""))


def _steps(spark, folder):
    events = files.read_table(spark, folder, "events")
    return events.select(
        F.lit("events").alias("model_name"), (F.col("event_id") % 4).alias("chain"), F.floor(F.col("event_id") / 4).alias("iteration"),
        F.col("value").alias("energy"), (F.col("value") > 300).alias("divergent"), (F.col("user_id") % 11).alias("treedepth"))


STEPS = """steps AS (SELECT 'events' AS model_name, event_id % 4 AS chain, event_id // 4 AS iteration, value AS energy,
  value > 300 AS divergent, user_id % 11 AS treedepth FROM events)"""
add("p9_energy_fraction", lambda spark, folder: tidy(checks.energy_fraction(_steps(spark, folder))), query(STEPS, """
moves AS (SELECT *, energy - lag(energy) OVER (PARTITION BY chain ORDER BY iteration) AS step FROM steps),
parts AS (SELECT model_name, chain, sum(step * step) / (var_samp(energy) * (count(*) - 1)) AS ebfmi FROM moves GROUP BY 1, 2)""",
    f"SELECT model_name, chain, {rounded('ebfmi')}, ebfmi > 0.2 AS mixing FROM parts"))
add("p9_sampler_warnings", lambda spark, folder: tidy(checks.sampler_warnings(_steps(spark, folder))), query(STEPS, """
SELECT model_name, count(*) FILTER (divergent) AS divergences, count(*) FILTER (treedepth >= 10) AS depth_hits, count(*) AS steps FROM steps GROUP BY 1"""))


def _predictive(spark, folder):
    _, fit, wide = model_draws(spark, folder, TIME_MODEL, 10)
    rows = prep.with_site_flags(prep.comparable_sites(views.swabs(spark, folder)))
    return tidy(checks.predictive_check(rows, "event_id", wide, fit.design))


add("p10_predictive_check", _predictive)


def _quantity_check(spark, folder):
    _, fit, wide = model_draws(spark, folder, HURDLE_MODEL, 10)
    rows = prep.with_site_flags(prep.comparable_sites(groups.first_samples(views.swabs(spark, folder))))
    return tidy(checks.quantity_check(rows, "event_id", wide, fit.design, (0.0, 4.0, 20)))


add("p10_quantity_check", _quantity_check)

EDGES = (0.0, 4.0, 33)


def _density_rows(spark, folder, first):
    swabs = views.swabs(spark, folder)
    return prep.with_site_flags(prep.comparable_sites(groups.first_samples(swabs) if first else swabs))


def _density(spark, folder, name=HURDLE_MODEL):
    model = catalog.MODELS[name]
    rows = _density_rows(spark, folder, model.variant.startswith("spatial"))
    if model.strata:
        table = catalog.model_table(name, views.swabs(spark, folder))
        wide = strata.strata_draws(spark, catalog.fit_table(name, table), model.strata, 10)
        rows = groups.standard_score(rows, model.scaled) if model.scaled else rows
        return tidy(densities.density_check(rows, wide, model.design, "event_id", model.family, EDGES, 10, model.strata), 4)
    if model.room_level:
        fit = catalog.fit_model(name, views.swabs(spark, folder))
        return tidy(densities.density_check(rows, rooms.room_draws(fit, 10), model.design, "event_id", model.family, EDGES, 10, [fit.group]), 4)
    _, fit, wide = model_draws(spark, folder, name, 10)
    return tidy(densities.density_check(rows, wide, fit.design, "event_id", model.family, EDGES), 4)


def _uniform_sql(salt):
    a, b = normal.primes(2 * salt + 2)[-2:]
    x = f"((event_id % {densities.PERIOD} + 1) * sqrt({float(a)!r}::DOUBLE) + (draw + 1) * sqrt({float(b)!r}::DOUBLE))"
    return f"least(greatest({x} - floor({x}), 1e-9), 1 - 1e-9)"


STEP = (EDGES[1] - EDGES[0]) / (EDGES[2] - 1)
add("p10_density_hurdle", _density, query(*[x.replace(f"range({DRAWS})", "range(10)") for x in HURDLE_DRAWS], f"""
rowed AS (SELECT event_id, copies_max, distance, CASE WHEN site_descriptor LIKE '%floor%' THEN 'Floor' ELSE 'Elevated' END AS site_category, touch = 'High' AS high_touch
  FROM first_samples WHERE NOT regexp_matches(site_descriptor, 'bathroom|sink|toilet|nurse')),
used AS (SELECT * FROM rowed WHERE event_id IS NOT NULL AND distance IS NOT NULL AND high_touch IS NOT NULL),
drawn AS (SELECT draw, {linear(4, HURDLE_TERMS)} AS mu, sigma, hu, {_uniform_sql(0)} AS u, {_uniform_sql(1)} AS v FROM used, draws),
values_ AS (SELECT draw, (mu + sigma * ({inverse_normal('v')})) / ln(10) AS x FROM drawn WHERE u >= hu
  UNION ALL SELECT -1, log10(copies_max) FROM used WHERE copies_max > 0),
placed AS (SELECT draw, least(greatest((x - {EDGES[0]}) / {STEP}, 0), {EDGES[2] - 1}) AS spot FROM values_),
shared AS (SELECT draw, spot, least(floor(spot), {EDGES[2] - 2}) AS b FROM placed),
binned AS MATERIALIZED (SELECT draw, bin, sum(w) AS weight, any_value({EDGES[0]} + bin * {STEP}) AS x FROM
  (SELECT draw, b AS bin, b + 1 - spot AS w FROM shared UNION ALL SELECT draw, b + 1, spot - b FROM shared) GROUP BY 1, 2),
wide AS (SELECT draw, sum(weight) AS n, greatest(0.9 * sqrt(greatest(sum(weight * x * x) / sum(weight) - (sum(weight * x) / sum(weight)) ** 2, 0)) * sum(weight) ** (-0.2::DOUBLE), {STEP}) AS h
  FROM binned GROUP BY 1)""", f"""
SELECT w.draw, i AS bin, {rounded(f'CAST(any_value({EDGES[0]} + i * {STEP}) AS DOUBLE)', 'x', 4)}, {rounded('coalesce(sum(CASE WHEN bin = i THEN weight END), 0)', 'weight', 4)},
  {rounded(f'sum(weight * exp(-0.5 * (({EDGES[0]} + i * {STEP} - x) / h) ** 2) / (h * n * sqrt(2 * pi())))', 'density', 4)}
FROM wide w CROSS JOIN range({EDGES[2]}) g(i) JOIN binned USING (draw) GROUP BY w.draw, i"""))
for _name in ("linear_distance_mix_category_touch", "hurdle_time_mix_category", "binom_time_mix_category_touch", "mvhurdle_distance_category_touch_mix_subject"):
    add(f"p10_density_{_name}", partial(_density, name=_name))

SHARED = ["subject_covid_day", "total_study_day", "site_category", "high_touch", "covid_severity"]


def observation_counts(table, columns=tuple(SHARED)):
    """Distinct (covariates, outcome) rows and how often they occur."""
    rows = table.select("scv2_detected", *columns).dropna()
    return rows.groupBy(F.col("scv2_detected").cast("int").alias("y"), *columns).agg(F.count(F.lit(1)).alias("n"))


def _scores(spark, folder, smooth, count=DRAWS):
    parts = {}
    for name in (SEVERITY_MODEL, SEVERITY_SITE_MODEL):
        table, fit, wide = model_draws(spark, folder, name, count)
        parts[name] = checks.leave_one_out(observation_counts(table), SHARED, wide, fit.design, smooth)
    return reshape.stack(parts)


def _loo_parts():
    first, second = fit_parts(SEVERITY_MODEL, "plain"), fit_parts(SEVERITY_SITE_MODEL, "crossed")
    p, q = len(TERMS[SEVERITY_MODEL]) + 1, len(TERMS[SEVERITY_SITE_MODEL]) + 1
    ctes = [*first, *[x for x in second if x not in first], normal_scores(DRAWS, q),
            draw_sql("plain_draws", "plain", p, DRAWS), draw_sql("crossed_draws", "crossed", q, DRAWS),
            f"observed AS MATERIALIZED (SELECT CAST(scv2_detected AS INTEGER) AS y, {', '.join(SHARED)}, count(*) AS n FROM severity WHERE covid_severity IS NOT NULL GROUP BY ALL)"]
    for alias, name, size in (("plain", SEVERITY_MODEL, p), ("crossed", SEVERITY_SITE_MODEL, q)):
        ctes.append(f"""{alias}_scores AS (SELECT '{name}' AS model_name, y, {', '.join(SHARED)}, any_value(n) AS n,
          -ln(avg(exp(-(y * eta - ln(1 + exp(eta)))))) AS elpd
          FROM (SELECT o.*, {linear(size, TERMS[name])} AS eta FROM observed o, {alias}_draws) GROUP BY y, {', '.join(SHARED)})""")
    ctes.append("scores_all AS MATERIALIZED (SELECT * FROM plain_scores UNION ALL SELECT * FROM crossed_scores)")
    return ctes


add("p11_importance_scores", lambda spark, folder: tidy(_scores(spark, folder, False).select(
    "model_name", "y", *SHARED, "n", "elpd"), 4), query(*_loo_parts(), f"""
    SELECT model_name, CAST(y AS BIGINT) AS y, CAST(subject_covid_day AS BIGINT) AS subject_covid_day, CAST(total_study_day AS BIGINT) AS total_study_day,
    site_category, high_touch, covid_severity, n, {rounded('elpd', digits=4)} FROM scores_all"""))
add("p11_smoothed_totals", lambda spark, folder: tidy(checks.score_totals(_scores(spark, folder, True), ["model_name"]), 3))


def _left_out_rooms(spark, folder, name="mvbinom_time_category_touch_mix_subject"):
    return tidy(rooms.leave_room_out(catalog.fit_model(name, views.swabs(spark, folder)), THINNED), 3)


add("p11_leave_room_out", _left_out_rooms)


def _comparison(spark, folder, names):
    swabs, subjects = views.swabs(spark, folder), views.subjects(spark, folder)
    return tidy(strata.compare_catalogue(names, swabs, subjects, DRAWS), 3)


for _names in catalog.COMPARISONS:
    add(f"p12_compare_{_names[0]}", partial(_comparison, names=_names))
add("p12_compare_models", lambda spark, folder: tidy(checks.compare_models(
    _scores(spark, folder, False), ["y", *SHARED]), 3), query(*_loo_parts(), f"""
    totals AS (SELECT model_name, sum(n * elpd) AS total FROM scores_all GROUP BY 1),
    top AS (SELECT s.* FROM scores_all s WHERE model_name = (SELECT model_name FROM totals ORDER BY total DESC, model_name DESC LIMIT 1)),
    pairs AS (SELECT s.model_name, s.n, s.elpd, s.elpd - t.elpd AS d FROM scores_all s JOIN top t USING (y, {', '.join(SHARED)}))""", f"""
    SELECT model_name, {rounded('sum(n * d)', 'elpd_diff', 3)},
    {rounded('sqrt(sum(n) * greatest((sum(n * d * d) - sum(n * d) * sum(n * d) / sum(n)) / (sum(n) - 1), 0))', 'se_diff', 3)},
    {rounded('sum(n * elpd)', 'elpd_loo', 3)}, rank() OVER (ORDER BY sum(n * d) DESC) AS rank FROM pairs GROUP BY 1"""))
add("p13_model_frame", on_both(lambda s, p: prep.model_frame(
    prep.analysis_table(s, "severity", p), ["scv2_detected", *catalog.MODELS[SEVERITY_MODEL].design.columns])),
    query(SWABS, SUBJECTS, SEVERITY, """SELECT scv2_detected, CAST(subject_covid_day AS BIGINT) AS subject_covid_day, site_category,
    CAST(total_study_day AS BIGINT) AS total_study_day, high_touch, covid_severity FROM severity WHERE covid_severity IS NOT NULL"""))
add("v1_points", on_swabs(lambda s: prep.with_contact_label(prep.analysis_table(s, "spatial_days")).where("copies_max IS NOT NULL").select(
    F.col("distance").alias("x"), C.log10_abundance(F.col("copies_max")).alias("y"), "site_category", "high_touch")),
    query(SWABS, SPATIAL_DAYS, f"""SELECT {rounded('distance', 'x')}, {rounded('log10(copies_max)', 'y')}, site_category,
    CASE WHEN high_touch THEN 'High Touch' ELSE 'Low Touch' END AS high_touch FROM spatial_days WHERE copies_max IS NOT NULL"""))


def _stored_draws(spark, folder):
    """Draws of two models through the model store, one read back."""
    path = shared_path(spark, "models")
    for name in (DISTANCE_MODEL, TIME_MODEL):
        _, fit, wide = model_draws(spark, folder, name)
        model_store.write_draws(posterior.long_draws(wide, fit.design, name), path)
    back = model_store.read_draws(spark, path, DISTANCE_MODEL)
    fit_design = catalog.MODELS[DISTANCE_MODEL].design
    return tidy(posterior.wide_draws(back, fit_design).drop("sigma", "hu"), 4)


add("s2_stored_models", _stored_draws, query(*draw_parts(DISTANCE_MODEL), "SELECT draw, " + ", ".join(
    rounded(f"b{i}", digits=4) for i in range(4)) + " FROM draws"))


def _model_infos(spark, folder):
    """What the store says of its models; the second write replaces one of them."""
    path = shared_path(spark, "models")
    for name in (DISTANCE_MODEL, TIME_MODEL, DISTANCE_MODEL):
        _, fit, wide = model_draws(spark, folder, name, THINNED)
        model_store.write_draws(posterior.long_draws(wide, fit.design, name), path, about=[catalog.model_info(name, fit)])
    return tidy(model_store.read_models(spark, path).drop("version"))


def _info_sql(name, source, day):
    return f"""SELECT '{name}' AS model_name, 'bernoulli' AS family, '{catalog.formula(name)}' AS formula, CAST(count(*) AS DOUBLE) AS fitted_rows,
      true AS converged, {THINNED}::BIGINT AS draws FROM {source} WHERE scv2_detected IS NOT NULL AND {day} IS NOT NULL AND site_category IS NOT NULL AND high_touch IS NOT NULL"""


add("s2_model_table", _model_infos, query(SWABS, SPATIAL_DAYS, LONG_DAYS, f"""{_info_sql(DISTANCE_MODEL, 'spatial_days', 'distance')}
    UNION ALL {_info_sql(TIME_MODEL, 'longitudinal_days', 'subject_covid_day')}"""))
