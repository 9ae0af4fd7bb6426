import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelight.plans import catalog, checks, design, draws, fits, pooling, rooms
from tracelight.plans.design import Design
from tracelight.sources import model_store
from tracelight.session import shared_path

SCHEMA = "subject_room_id string, distance double, site_category string, high_touch boolean, scv2_detected boolean, copies_max double"
TRUE = np.array([-1.0, 0.3, 2.0, 1.0])
FIXED = Design(("distance", "site_category", "high_touch"))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(4000):
        cell = i % 3
        distance = float(i % 7)
        x = np.array([1.0, distance, cell == 0, cell == 1], float)
        found = bool(rng.random() < 1 / (1 + math.exp(-(TRUE @ x))))
        copies = float(np.exp(2.0 + 0.1 * distance + 0.5 * rng.normal())) if found else None
        rows.append((f"r{i % 40}", distance, "Floor" if cell == 0 else "Elevated", cell == 1, found, copies))
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_design_names_and_columns(spark):
    crossed = catalog.MODELS["mvbinom_time_adjust_wave_severity_site"].design
    assert crossed.parameters[:5] == ["b_Intercept", "b_subject_covid_day", "b_site_categoryFloor", "b_total_study_day", "b_high_touchTRUE"]
    assert crossed.parameters[-1] == "b_site_categoryFloor:covid_severitySignificantOxygenSupport"
    row = spark.createDataFrame([(2.0, "Floor", True)], "distance double, site_category string, high_touch boolean")
    assert tuple(design.design_columns(row, FIXED).first()) == (1.0, 2.0, 1.0, 1.0)


def test_catalogue_is_complete():
    assert len(catalog.MODELS) == 23
    assert {m.family for m in catalog.MODELS.values()} == {"bernoulli", "gaussian", "hurdle_lognormal"}
    assert all(name in catalog.MODELS for group in catalog.COMPARISONS for name in group)


def test_parameter_listing():
    rows = design.parameter_listing(FIXED, "hurdle_lognormal", "subject_room_id", ["Intercept", "distance"], {"sd": "normal(0, 1)"})
    classes = [r[1] for r in rows]
    assert classes.count("b") == 4 and "hu" in classes and "sigma" in classes and "cor" in classes
    assert ("normal(0, 1)", "sd", "distance", "subject_room_id") in rows


def test_patterns_are_lossless(table):
    patterns = design.bernoulli_patterns(table, FIXED)
    totals = patterns.agg(F.sum("n"), F.sum("k")).first()
    assert totals[0] == 4000 and totals[1] == table.where("scv2_detected").count()
    assert patterns.count() <= 21


def test_logistic_fit_recovers_and_has_zero_score(table):
    fit = fits.fit_bernoulli(table, FIXED, prior_sd=None)[()]
    errors = np.sqrt(np.diag(fit.covariance))
    assert np.all(np.abs(fit.beta - TRUE) < 4 * errors)
    gradient, _, _, rows = fits.bernoulli_sums(design.bernoulli_patterns(table, FIXED), {(): fit.beta}, 4)[()]
    assert np.max(np.abs(gradient)) < 1e-6 and rows == 4000


def test_saturated_fit_equals_cell_log_odds(table):
    saturated = Design(("site_category", "high_touch"))
    fit = fits.fit_bernoulli(table, saturated, prior_sd=None)[()]
    odds = {(r.site_category, r.high_touch): r.log_odds for r in fits.cell_log_odds(table, ["site_category", "high_touch"]).collect()}
    base = odds["Elevated", False]
    assert np.allclose(fit.beta, [base, odds["Floor", False] - base, odds["Elevated", True] - base])


def test_separated_cell_stays_finite(spark):
    rows = spark.createDataFrame([("Floor", True)] * 20 + [("Elevated", False)] * 20, "site_category string, scv2_detected boolean")
    fit = fits.fit_bernoulli(rows, Design(("site_category",)))[()]
    assert np.all(np.isfinite(fit.beta)) and fit.beta[1] > 4


def test_strata_equal_separate_fits(table):
    line = Design(("distance",))
    together = fits.fit_bernoulli(table, line, keys=["site_category"])
    alone = fits.fit_bernoulli(table.where("site_category = 'Floor'"), line)[()]
    assert np.allclose(together[("Floor",)].beta, alone.beta, atol=1e-8)


def test_linear_and_hurdle_fits_equal_numpy(table):
    data = [r for r in table.collect() if r.copies_max is not None]
    x = np.array([[1.0, r.distance, r.site_category == "Floor", r.high_touch] for r in data], float)
    y = np.log([r.copies_max for r in data])
    expected, residual, *_ = np.linalg.lstsq(x, y, rcond=None)
    fit = fits.fit_hurdle(table, FIXED)[()]
    assert np.allclose(fit.beta, expected) and math.isclose(fit.sigma, math.sqrt(residual[0] / (len(y) - 4)), rel_tol=1e-9)
    assert math.isclose(fit.hurdle, 1 - len(y) / 4000)
    lines = {r.site_category: r for r in fits.simple_lines(table, "distance", F.log("copies_max"), ["site_category"]).collect()}
    single = fits.least_squares(table, Design(("distance",)), F.log("copies_max"), ["site_category"])
    for key, other in single.items():
        assert np.allclose([lines[key[0]].intercept, lines[key[0]].slope, lines[key[0]].sigma], [*other.beta, other.sigma])


def test_pooling_shrinks_towards_the_centre(table):
    found = fits.fit_bernoulli(table, Design(("distance",)), keys=["site_category", "high_touch"])
    pooled = pooling.pool(found, np.zeros(2))
    # Shrinkage holds in the metric of the spread, not in each coordinate.
    metric = np.linalg.inv(pooled.spread)
    for key, fit in found.items():
        shrunk = pooled.estimates[key]
        assert shrunk @ metric @ shrunk <= fit.beta @ metric @ fit.beta * (1 + 1e-6)
    nested = pooling.pool_nested(found, np.zeros(2))
    assert set(nested.estimates) == set(found)
    assert np.all(np.linalg.eigvalsh(nested.spread) > 0)


def test_room_fit_improves_and_shrinks(spark):
    rng = np.random.default_rng(4)
    rows = []
    for room in range(30):
        level = rng.normal()
        for i in range(200 if room == 0 else 20):
            rows.append((f"r{room}", float(i % 4), bool(rng.random() < 1 / (1 + math.exp(-(0.5 + level))))))
    frame = spark.createDataFrame(rows, "subject_room_id string, distance double, scv2_detected boolean")
    fit = rooms.fit_rooms(frame, Design(()))
    assert fit.converged and fit.history[-1] >= max(fit.history) - 0.05
    other = rooms.fit_rooms(frame, Design(()), start=0.05)
    assert np.allclose(other.spread, fit.spread, rtol=1e-3) and abs(other.intercept - fit.intercept) < 1e-3
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert not rooms.fit_rooms(frame, Design(()), rounds=1).converged
    assert any("not converged" in str(w.message) for w in caught)
    effects = {r.subject_room_id: r.u0 for r in fit.effects.collect()}
    raw = {}
    for room, _, found in rows:
        raw.setdefault(room, []).append(found)
    assert fit.rows == len(rows) and len(effects) == 30
    shares = {k: np.clip(np.mean(v), 0.02, 0.98) for k, v in raw.items()}
    order = sorted(effects, key=effects.get)
    assert np.corrcoef([effects[k] for k in order], [math.log(shares[k] / (1 - shares[k])) for k in order])[0, 1] > 0.95
    sample = rooms.room_draws(fit, 50)
    assert sample.count() == 1500
    mean = sample.where("subject_room_id = 'r0'").agg(F.avg("b0")).first()[0]
    assert abs(mean - (fit.intercept + effects["r0"])) < 0.2


def test_room_draws_keep_the_covariance_with_the_intercept(spark):
    rng = np.random.default_rng(12)
    y = [(f"r{room}", bool(rng.random() < 1 / (1 + math.exp(-0.8 * rng.normal())))) for room in range(10) for _ in range(300 if room < 2 else 12)]
    frame = spark.createDataFrame(y, "subject_room_id string, scv2_detected boolean")
    fit = rooms.fit_rooms(frame, Design(()))
    # Dense curvature at the mode: intercept first, then the ten rooms.
    effects = {r.subject_room_id: r.u0 for r in fit.effects.collect()}
    keys = sorted(effects)
    h = np.zeros((11, 11))
    h[0, 0] = 1.0
    for i, key in enumerate(keys, 1):
        m = 1 / (1 + math.exp(-(fit.intercept + effects[key])))
        w = sum(k == key for k, _ in y) * m * (1 - m)
        h[0, 0] += w
        h[0, i] = h[i, 0] = w
        h[i, i] = w + 1 / fit.spread[0, 0]
    dense = np.linalg.inv(h)
    got = {r.subject_room_id: r.v for r in rooms.room_draws(fit, 2000).groupBy("subject_room_id").agg(F.var_samp("b0").alias("v")).collect()}
    for i, key in enumerate(keys, 1):
        assert math.isclose(got[key], dense[0, 0] + dense[i, i] + 2 * dense[0, i], rel_tol=0.15)


def test_room_lognormal_fit(spark):
    rng = np.random.default_rng(8)
    rows = []
    for room in range(20):
        level = 0.7 * rng.normal()
        for i in range(25):
            rows.append((f"r{room}", float(i % 5), float(np.exp(3 + level + 0.4 * rng.normal())) if i % 4 else None))
    frame = spark.createDataFrame(rows, "subject_room_id string, distance double, copies_max double")
    fit = rooms.fit_rooms_lognormal(frame, Design(("distance",)))
    assert abs(fit.sigma - 0.4) < 0.08 and abs(fit.hurdle - 0.28) < 0.01
    assert 0.2 < math.sqrt(fit.spread[0, 0]) < 1.2 and fit.converged


def test_weak_strata_keep_a_finite_line(spark):
    rng = np.random.default_rng(6)
    rows = [("wide", float(i % 9), float(np.exp(1 + 0.2 * (i % 9) + 0.3 * rng.normal()))) for i in range(90)]
    rows += [("one row", 2.0, 5.0)] + [("one value", 3.0, float(v)) for v in (2, 4, 8, 16)] + [("nothing", float(i), None) for i in range(5)]
    frame = spark.createDataFrame(rows, "site_category string, distance double, copies_max double")
    found = fits.fit_hurdle(frame, Design(("distance",)), keys=["site_category"])
    assert set(found) == {("wide",), ("one row",), ("one value",), ("nothing",)}
    assert all(np.all(np.isfinite(f.beta)) and np.all(np.linalg.eigvalsh(f.covariance) > 0) for f in found.values())
    assert abs(found[("one value",)].beta @ [1, 3] - np.log([2, 4, 8, 16]).mean()) < 0.05
    assert found[("nothing",)].hurdle == 1.0 and found[("one row",)].sigma == found[("wide",)].sigma
    pooled = pooling.pool(found)
    assert pooled.converged and pooled.stratum(("wide",)).hurdle == 0.0


def test_nested_pooling_equals_a_dense_posterior():
    design_ = Design(())
    fit = lambda b, v: fits.Fit(design_, "bernoulli", np.array([b]), np.array([[v]]))
    found = {("a", 1): fit(1.0, 0.2), ("a", 2): fit(1.6, 0.3), ("b", 1): fit(-0.5, 0.4)}
    within, between = np.array([[0.5]]), np.array([[1.2]])
    at, errors = pooling.joint_posterior(found, within, between, np.zeros(1))
    # Marginal prior of the three children, then Bayes' rule.
    prior = np.diag([0.5] * 3) + 1.2 * np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1]])
    noise = np.diag([0.2, 0.3, 0.4])
    gain = prior @ np.linalg.inv(prior + noise)
    assert np.allclose([at[k][0] for k in found], gain @ [1.0, 1.6, -0.5])
    assert np.allclose([errors[k][0, 0] for k in found], np.diag(prior - gain @ prior))
    pooled = pooling.pool_nested(found, np.zeros(1))
    again = pooling.joint_posterior(found, pooled.spread, pooled.upper, np.zeros(1))
    assert np.allclose([pooled.covariances[k] for k in found], [again[1][k] for k in found])


def test_draws_have_the_fitted_moments(spark, table):
    fit = fits.fit_bernoulli(table, FIXED)[()]
    wide = draws.laplace_draws(spark, fit, 2000)
    matrix = draws.draw_matrix(wide, 4)
    assert np.allclose(matrix.mean(axis=0), fit.beta, atol=0.02)
    assert np.allclose(np.cov(matrix.T), fit.covariance, atol=0.1 * np.max(fit.covariance))
    weights, size = draws.importance_weights(design.bernoulli_patterns(table, FIXED), wide, fit)
    assert size > 1500
    again = draws.resample(wide, weights, 1000)
    assert again.count() == 1000 and again.select("draw").distinct().count() == 1000


def test_store_round_trip_and_overwrite(spark, table):
    fit = fits.fit_bernoulli(table, FIXED)[()]
    wide = draws.laplace_draws(spark, fit, 20)
    path = shared_path(spark, "store")
    model_store.write_draws(draws.long_draws(wide, FIXED, "one"), path)
    model_store.write_draws(draws.long_draws(draws.thin(wide, 10), FIXED, "two"), path)
    model_store.write_draws(draws.long_draws(draws.thin(wide, 5), FIXED, "two"), path)
    assert model_store.read_draws(spark, path, "one").count() == 80
    assert model_store.read_draws(spark, path, "two").count() == 20
    plan = model_store.read_draws(spark, path, "one")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model_name" in plan
    back = draws.draw_matrix(draws.wide_draws(model_store.read_draws(spark, path, "one"), FIXED), 4)
    assert np.allclose(back, draws.draw_matrix(wide, 4))


def test_expected_draws_follow_the_link(spark, table):
    fit = fits.fit_hurdle(table, FIXED)[()]
    wide = draws.laplace_draws(spark, fit, 8)
    grid = spark.createDataFrame([(1.0, "Floor", False)], "distance double, site_category string, high_touch boolean")
    rows = {r.draw: r for r in wide.collect()}
    for r in draws.expected_draws(grid, wide, FIXED, 8, "hurdle_lognormal").collect():
        d = rows[r.draw]
        mu = d.b0 + d.b1 + d.b2
        assert math.isclose(r.epred, (1 - d.hu) * math.exp(mu + d.sigma**2 / 2), rel_tol=1e-9)


def test_smoothed_scores_approach_refitted_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(float(x), bool(rng.random() < 1 / (1 + math.exp(-(0.5 * x - 0.5))))) for x in np.linspace(-2, 3, 40)]
    frame = spark.createDataFrame(rows, "distance double, scv2_detected boolean")
    line = Design(("distance",))
    fit = fits.fit_bernoulli(frame, line, prior_sd=2.0)[()]
    wide = draws.laplace_draws(spark, fit, 1000)
    counts = frame.groupBy(F.col("scv2_detected").cast("int").alias("y"), "distance").agg(F.count("*").alias("n"))
    scores = checks.leave_one_out(counts, ["distance"], wide, line)
    got = {r.distance: r for r in scores.collect()}
    x = np.array([[1.0, d] for d, _ in rows])
    y = np.array([float(v) for _, v in rows])
    for i in (0, 20, 39):
        keep = np.arange(40) != i
        beta = np.zeros(2)
        for _ in range(30):
            m = 1 / (1 + np.exp(-x[keep] @ beta))
            h = (x[keep] * (m * (1 - m))[:, None]).T @ x[keep] + np.eye(2) / 4
            beta += np.linalg.solve(h, x[keep].T @ (y[keep] - m) - beta / 4)
        sample = rng.multivariate_normal(beta, np.linalg.inv(h), 20000)
        exact = np.log(np.mean(1 / (1 + np.exp(-(2 * y[i] - 1) * (sample @ x[i])))))
        assert abs(got[rows[i][0]].elpd - exact) < 0.15
        assert got[rows[i][0]].shape < 0.7
    totals = checks.score_totals(scores).first()
    assert math.isclose(totals.elpd_loo, sum(r.elpd * r.n for r in got.values()), rel_tol=1e-9)


def test_hurdle_scores_equal_plain_importance_sampling(spark, table):
    fit = fits.fit_hurdle(table, FIXED)[()]
    wide = draws.laplace_draws(spark, fit, 60)
    y = F.coalesce("copies_max", F.lit(0.0))
    counts = table.limit(30).groupBy(y.alias("y"), *FIXED.columns).agg(F.count("*").alias("n"))
    scores = checks.leave_one_out(counts, FIXED.columns, wide, FIXED, smooth=False, family="hurdle_lognormal")
    sample = wide.collect()
    for r in scores.collect():
        inverse = []
        for d in sample:
            mu = d.b0 + d.b1 * r.distance + d.b2 * (r.site_category == "Floor") + d.b3 * r.high_touch
            if r.y > 0:
                z = (math.log(r.y) - mu) / d.sigma
                like = (1 - d.hu) * math.exp(-z * z / 2) / (r.y * d.sigma * math.sqrt(2 * math.pi))
            else:
                like = d.hu
            inverse.append(1 / like)
        assert math.isclose(r.elpd, -math.log(np.mean(inverse)), rel_tol=1e-9)


def test_compare_models_ranks_the_best_first(spark):
    rows = [("good", i, 1, -0.5 - 0.01 * i) for i in range(10)] + [("bad", i, 1, -1.0) for i in range(10)]
    scores = spark.createDataFrame(rows, "model_name string, id int, n bigint, elpd double")
    got = {r.model_name: r for r in checks.compare_models(scores, ["id"]).collect()}
    d = np.array([-1.0 - (-0.5 - 0.01 * i) for i in range(10)])
    assert got["good"].rank == 1 and got["good"].elpd_diff == 0.0
    assert math.isclose(got["bad"].elpd_diff, d.sum(), rel_tol=1e-9)
    assert math.isclose(got["bad"].se_diff, math.sqrt(10) * d.std(ddof=1), rel_tol=1e-6)


def test_compared_models_must_score_the_same_rows(spark):
    kind = "model_name string, id int, n bigint, elpd double"
    for other in ([("b", 0, 1, -1.0)], [("b", 0, 1, -1.0), ("b", 1, 2, -1.0)], [("b", 0, 1, -1.0), ("b", 7, 1, -1.0)]):
        scores = spark.createDataFrame([("a", 0, 1, -0.5), ("a", 1, 1, -0.5), *other], kind)
        with pytest.raises(ValueError, match="rows or weights"):
            checks.compare_models(scores, ["id"])
    one = checks.compare_models(spark.createDataFrame([("a", 0, 1, -0.5), ("b", 0, 1, -0.7)], kind), ["id"]).collect()
    assert [r.se_diff for r in one] == [None, None]


def test_chain_checks(spark):
    rng = np.random.default_rng(1)
    rows = [("m", c, i, i, "p", float(rng.normal() + 5 * (c == 3))) for c in range(4) for i in range(50)]
    bad = checks.chain_convergence(spark.createDataFrame(rows, "model_name string, chain int, iteration bigint, draw bigint, param string, value double")).first()
    assert bad.rhat > 1.1 and not bad.converged
    energy = rng.normal(size=60)
    steps = spark.createDataFrame([("m", 0, i, float(e), False, 3) for i, e in enumerate(energy)],
                                  "model_name string, chain int, iteration bigint, energy double, divergent boolean, treedepth int")
    expected = np.sum(np.diff(energy) ** 2) / np.sum((energy - energy.mean()) ** 2)
    assert math.isclose(checks.energy_fraction(steps).first().ebfmi, expected, rel_tol=1e-9)
    assert tuple(checks.sampler_warnings(steps).first()) == ("m", 0, 0, 60)


def test_predictive_check_matches_the_fit(spark, table):
    fit = fits.fit_bernoulli(table, FIXED)[()]
    wide = draws.laplace_draws(spark, fit, 5)
    rows = table.withColumn("id", F.monotonically_increasing_id())
    for r in checks.predictive_check(rows, "id", wide, FIXED, 5).collect():
        assert abs(r.simulated - r.observed) < 0.05


def test_poor_approximation_warns(spark, table):
    fit = fits.fit_bernoulli(table, FIXED)[()]
    fit.covariance = fit.covariance * 25
    wide = draws.laplace_draws(spark, fit, 200)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        draws.importance_weights(design.bernoulli_patterns(table, FIXED), wide, fit)
    assert any("effective sample size" in str(w.message) for w in caught)


def test_prior_listing_follows_the_levels_that_occur(spark):
    frame = spark.createDataFrame([("Elevated", True, 1.0), ("Floor", None, 2.0), ("Elevated", False, 3.0)], "site_category string, high_touch boolean, distance double")
    full = design.Design(("distance", "site_category", "high_touch"))
    got = sorted(tuple(r) for r in design.prior_listing(frame, full, "hurdle_lognormal").collect())
    # The row with the floor is not complete, so that level does not occur.
    assert got == sorted([("student_t(3, 0, 2.5)", "Intercept", "", ""), ("", "b", "", ""), ("", "b", "distance", ""), ("", "b", "high_touchTRUE", ""),
                          ("student_t(3, 0, 2.5)", "sigma", "", ""), ("beta(1, 1)", "hu", "", "")])
    alone = design.prior_listing(frame, design.Design(()), "bernoulli", "room", {"sd": "normal(0, 1)"}).collect()
    assert sorted((r["class"], r.coef, r.group, r.prior) for r in alone) == [
        ("Intercept", "", "", "student_t(3, 0, 2.5)"), ("sd", "", "", "normal(0, 1)"), ("sd", "", "room", "normal(0, 1)"), ("sd", "Intercept", "room", "normal(0, 1)")]


def test_plain_scores_take_one_exponential_a_draw(monkeypatch):
    from tracelight.plans import checks

    rng = np.random.default_rng(4)
    x, matrix, y = rng.normal(size=(40, 3)), rng.normal(size=(500, 3)), rng.integers(0, 2, 40).astype(float)
    x[0] *= 300
    loglik = checks._log_likelihood(y, x, matrix, "bernoulli")
    top = -loglik.min(axis=1, keepdims=True)
    want = -(np.log(np.exp(-loglik - top).mean(axis=1)) + top[:, 0])
    # The likelihood itself, with two more transcendental functions for each row and draw, is not made.
    monkeypatch.delattr(checks, "_log_likelihood")
    assert np.allclose(checks.plain_scores(y, x, matrix, "bernoulli"), want, rtol=1e-13, atol=1e-13)
    with pytest.raises(ValueError, match="0 or 1"):
        checks.plain_scores(y + 1, x, matrix, "bernoulli")
