"""Pooling with the spread integrated out, against dense integration."""

import math

import numpy as np
import pytest

from tracelight.plans import catalog, mixture, strata
from tracelight.plans.fits import Fit
from tracelight.sources import views


def fit_of(beta, covariance, **more):
    fields = {"beta": np.array(beta, float), "covariance": np.array(covariance, float)} | more
    import inspect

    known = inspect.signature(Fit).parameters
    blank = {k: None for k, v in known.items() if v.default is inspect.Parameter.empty and k not in fields}
    return Fit(**(blank | fields))


def half_t(x, df=3.0, scale=2.5):
    return (1 + (x / scale) ** 2 / df) ** (-(df + 1) / 2)


def dense(fits, spreads, weights, middle):
    """Mean and sd of every stratum by direct sums over spreads (prior weights given)."""
    raw = np.array([f.beta for f in fits])
    many, p = raw.shape
    first, second, total = np.zeros((many, p)), np.zeros((many, p)), 0.0
    for s, w in zip(spreads, weights, strict=True):
        like, means, covers = w, [], []
        for f in fits:
            whole = f.covariance + s
            off = f.beta - middle
            like *= math.exp(-0.5 * off @ np.linalg.solve(whole, off)) / math.sqrt(np.linalg.det(whole))
            means.append(middle + s @ np.linalg.solve(whole, off))
            covers.append(np.diag(s - s @ np.linalg.solve(whole, s)))
        total += like
        first += like * np.array(means)
        second += like * (np.array(covers) + np.array(means) ** 2)
    mean = first / total
    return mean, np.sqrt(second / total - mean**2)


def test_two_strata_equal_dense_integration_over_one_sd():
    fits = {("a",): fit_of([0.9], [[0.04]]), ("b",): fit_of([-0.3], [[0.09]])}
    got = mixture.integrate(fits, np.zeros(1))
    sd = (np.arange(40_000) + 0.5) / 40_000 * 60
    mean, error = dense(list(fits.values()), (sd**2)[:, None, None], half_t(sd), np.zeros(1))
    for i, k in enumerate(fits):
        assert abs(got.estimates[k][0] - mean[i, 0]) < 1e-4 and abs(math.sqrt(got.covariances[k][0, 0]) - error[i, 0]) < 1e-4


def test_two_strata_equal_dense_integration_over_a_spread():
    fits = {("a",): fit_of([0.9, 0.05], [[0.04, 0.001], [0.001, 0.002]]), ("b",): fit_of([-0.3, -0.2], [[0.09, -0.004], [-0.004, 0.003]])}
    got = mixture.integrate(fits, np.zeros(2))
    u = (np.arange(44) + 0.5) / 44
    sd, jacobian = 2.5 * (u / (1 - u)) ** 1.5, 1.5 * (u / (1 - u)) ** 0.5 / (1 - u) ** 2
    r = (np.arange(24) + 0.5) / 12 - 1
    spreads = [np.array([[a * a, a * b * c], [a * b * c, b * b]]) for a in sd for b in sd for c in r]
    weights = [half_t(a) * j * half_t(b) * k for a, j in zip(sd, jacobian, strict=True) for b, k in zip(sd, jacobian, strict=True) for _ in r]
    mean, error = dense(list(fits.values()), spreads, weights, np.zeros(2))
    for i, k in enumerate(fits):
        assert np.allclose(got.estimates[k], mean[i], atol=4e-3) and np.allclose(np.sqrt(np.diag(got.covariances[k])), error[i], rtol=0.03)


def test_a_centre_that_is_not_given_is_the_strata_own():
    fits = {(k,): fit_of([x], [[0.05]]) for k, x in (("a", 7.2), ("b", 6.1), ("c", 6.4))}
    got = mixture.integrate(fits)
    assert all(6.1 < got.estimates[k][0] < 7.2 for k in fits) and got.covariances[("a",)][0, 0] < 0.06
    moved = mixture.integrate({k: fit_of(f.beta + 50, f.covariance) for k, f in fits.items()})
    assert all(abs(moved.estimates[k][0] - 50 - got.estimates[k][0]) < 1e-6 for k in fits)


def test_nested_set_equals_its_product_rule(monkeypatch):
    fits = {("a", "x"): fit_of([0.6], [[0.05]]), ("a", "y"): fit_of([0.2], [[0.04]]), ("b", "x"): fit_of([-0.8], [[0.06]])}
    product = mixture.integrate(fits, np.zeros(1))
    real = mixture._unknowns
    monkeypatch.setattr(mixture, "_unknowns", lambda p: real(p) + 2)  # too many for a product rule
    by_set = mixture.integrate(fits, np.zeros(1))
    for k in fits:
        assert abs(product.estimates[k][0] - by_set.estimates[k][0]) < 5e-3
        assert abs(product.covariances[k][0, 0] / by_set.covariances[k][0, 0] - 1) < 0.02


def test_limits_are_wider_than_at_one_spread(spark):
    from tracelight.plans.pooling import pool

    fits = {(k,): fit_of([x, y], 0.02 * np.eye(2), rows=50.0) for k, x, y in (("Elevated", 0.5, 0.1), ("Floor", -0.1, 0.0))}
    mixed, single = mixture.integrate(fits, np.zeros(2)), pool(fits, np.zeros(2))
    assert all(np.trace(mixed.covariances[k]) > np.trace(single.covariances[k]) for k in fits)
    found = mixture.mixture_draws(spark, mixed, ["site_category"], 4000).toPandas()
    for key, part in found.groupby("site_category"):
        got = part[["b0", "b1"]].to_numpy()
        assert len(got) == 4000 and np.allclose(got.mean(axis=0), mixed.estimates[(key,)], atol=0.01)
        assert np.allclose(np.cov(got.T), mixed.covariances[(key,)], atol=0.004)


@pytest.mark.parametrize("name", ["binom_distance_mix_category_touch", "hurdle_time_mix_category"])
def test_given_models_feed_the_ribbon(spark, name):
    swabs = views.swabs(spark, "/root/testdata/sf0.001")
    fit = catalog.fit_table(name, catalog.model_table(name, swabs))
    assert isinstance(fit, mixture.Mixture) and abs(fit.weights.sum() - 1) < 1e-9
    draws = strata.strata_draws(spark, fit, catalog.MODELS[name].strata, 200)
    assert draws.count() == 200 * len(fit.estimates) and draws.dropna().count() == draws.count()


@pytest.mark.parametrize("given", [True, False])
@pytest.mark.parametrize("scale", [1e-2, 1e-6, 1e-12])
def test_small_errors_of_many_rows_keep_the_strata(given, scale):
    """With many rows a stratum's error is far below the widest spreads: sums of both lost it, or could not be solved."""
    rng, keys = np.random.default_rng(4), [("E", False), ("E", True), ("F", False)]
    fits = {}
    for k in keys:
        a = rng.normal(size=(2, 2)) * np.array([[0.3], [0.01]])
        fits[k] = fit_of(rng.normal(size=2) * [1, 0.02], scale * (a @ a.T + np.diag([1e-3, 1e-6])))
    got = mixture.integrate(fits, np.zeros(2) if given else None)
    for k, f in fits.items():
        error = np.sqrt(np.diag(f.covariance))
        assert (np.abs(got.estimates[k] - f.beta) < 2 * error).all()
        assert np.allclose(np.sqrt(np.diag(got.covariances[k])), error, rtol=0.1)


def test_a_comparison_makes_its_table_once(spark, monkeypatch):
    folder, read = "/root/testdata/sf0.001", []
    fit, score = catalog.fit_table, strata.leave_one_out
    monkeypatch.setattr(catalog, "fit_table", lambda name, table, *a: read.append(table) or fit(name, table, *a))
    monkeypatch.setattr(strata, "leave_one_out", lambda counts, *a: read.append(counts) or score(counts, *a))
    names = catalog.COMPARISONS[-1]
    out = strata.compare_catalogue(names, views.swabs(spark, folder), views.subjects(spark, folder), 50).collect()
    assert {r.model_name for r in out} == set(names) and len(read) == 4
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in read]
    assert not any("Join" in p or "Aggregate" in p for p in plans)
