"""Room effects: integrals, optima and draws against dense computation."""

import math

import numpy as np
import pytest

from tracelight.plans import catalog, rooms
from tracelight.plans import room_likelihood as likelihood
from tracelight.plans.design import Design
from tracelight.sources import views


def room_of(rng, p, patterns=9):
    x = np.c_[np.ones(patterns), rng.normal(size=(patterns, p - 1))]
    n = rng.integers(1, 4, patterns).astype(float)
    return likelihood.Rows(x, n, rng.binomial(n.astype(int), 0.35).astype(float))


def dense(room, theta):
    """log of the room's integral by a fine product rule over all effects."""
    p = room.x.shape[1]
    lower = likelihood.unpacked(theta[1:], p)
    axis = np.linspace(-9, 9, 2001 if p == 1 else 601)
    z = np.stack(np.meshgrid(*[axis] * p, indexing="ij"), axis=-1).reshape(-1, p)
    eta = (z @ lower.T) @ room.x.T + theta[0]
    each = eta @ room.k - np.logaddexp(0, eta) @ room.n - 0.5 * (z * z).sum(axis=1) - 0.5 * p * math.log(2 * math.pi)
    return each.max() + math.log(np.exp(each - each.max()).sum()) + p * math.log(axis[1] - axis[0])


@pytest.mark.parametrize("p", [1, 2])
def test_nodes_equal_brute_force_integration(p):
    rng = np.random.default_rng(p)
    for patterns in (1, 3, 12):
        room = room_of(rng, p, patterns)
        thetas = rng.normal(0, 0.8, (4, 1 + p * (p + 1) // 2))
        thetas[0, 1:] = 0  # no spread at all
        value, _, _ = likelihood.room_terms(room, thetas[:, 0], likelihood.unpacked(thetas[:, 1:], p), likelihood.NODES[p])
        assert np.allclose(value, [dense(room, t) for t in thetas], atol=1e-6)


@pytest.mark.parametrize("p,nodes", [(1, None), (1, 31), (2, 21), (3, None), (4, None)])
def test_gradients_are_those_of_the_values(p, nodes):
    rng = np.random.default_rng(10 * p)
    rows = room_of(rng, p)
    centre = rng.normal(0, 0.3, p)
    value, g, h, third = (x[0] if isinstance(x, np.ndarray) else x for x in rows.at(centre[None]))
    t = np.stack([third(np.outer(e, f)[None])[0] for e in np.eye(p) for f in np.eye(p)]).reshape(p, p, p)
    far = likelihood.Expansion(centre, float(value), g, h, t)
    thetas = rng.normal(0, 0.5, (3, 1 + p * (p + 1) // 2))
    d = thetas.shape[1]
    for room in (rows, far) if nodes is None else (rows,):
        at = lambda x, room=room: likelihood.room_terms(room, x[:, 0], likelihood.unpacked(x[:, 1:], p), nodes)
        numeric = np.array([(at(thetas + 1e-5 * e)[0] - at(thetas - 1e-5 * e)[0]) / 2e-5 for e in np.eye(d)]).T
        assert np.allclose(at(thetas)[1], numeric, atol=1e-6)


@pytest.mark.parametrize("p,nodes", [(4, None), (2, 21)])
def test_many_rooms_at_once_equal_single_ones(p, nodes):
    """Rooms of other sizes, filled up with rows of no trials, are evaluated together."""
    rng = np.random.default_rng(50 + p)
    alone = [room_of(rng, p, patterns) for patterns in (1, 4, 9, 9, 12)]
    fill = lambda a: np.concatenate([a, np.zeros((12 - len(a), *a.shape[1:]))])
    together = likelihood.Rows(*(np.stack([fill(getattr(r, c)) for r in alone]) for c in ("x", "n", "k")))
    thetas = rng.normal(0, 0.8, (6, 1 + p * (p + 1) // 2))
    value, gradient, z = likelihood.room_terms(together, thetas[:, 0], likelihood.unpacked(thetas[:, 1:], p), nodes)
    assert value.shape == (5, 6) and gradient.shape == (5, 6, thetas.shape[1])
    for i, room in enumerate(alone):
        one = likelihood.room_terms(room, thetas[:, 0], likelihood.unpacked(thetas[:, 1:], p), nodes)
        assert all(np.allclose(a, b, atol=1e-9) for a, b in zip((value[i], gradient[i], z[i]), one, strict=True))


def one_by_one(room, b, lower):
    """Laplace's value of one room under one set, by a plain search for its mode."""
    p = room.x.shape[1]
    z = np.zeros(p)

    def at(z):
        eta = room.x @ (lower @ z + b * np.eye(p)[0])
        mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        value = room.k @ eta - room.n @ np.logaddexp(0, eta) - 0.5 * z @ z
        matrix = np.eye(p) + lower.T @ (room.x.T * (room.n * mu * (1 - mu))) @ room.x @ lower
        return value, lower.T @ room.x.T @ (room.k - room.n * mu) - z, matrix

    for _ in range(500):
        value, g, matrix = at(z)
        step, size = np.linalg.solve(matrix, g), 1.0
        while at(z + size * step)[0] < value - 1e-12 * abs(value) and size > 1e-9:
            size /= 2
        z = z + size * step
    value, _, matrix = at(z)
    return value - 0.5 * np.linalg.slogdet(matrix)[1], z


def test_rooms_at_once_find_the_mode_of_each_also_far_from_the_first_set():
    """Rooms of one outcome, repeated trials, predictors beyond exp, and sets far apart."""
    rng = np.random.default_rng(77)
    alone = [room_of(rng, 4, 9) for _ in range(6)]
    alone[0].k[:] = alone[0].n  # every trial a success
    alone[1].k[:] = 0
    alone[2].n *= 400  # too many trials to multiply their chances
    alone[2].k *= 380
    alone[3].x[:, 2] *= 40
    thetas = rng.normal(0, 0.3, (9, 11))
    thetas[5:] = rng.normal(0, 4, (4, 11))
    lower = likelihood.unpacked(thetas[:, 1:], 4)
    together = likelihood.Rows(*(np.stack([getattr(r, c) for r in alone]) for c in ("x", "n", "k")))
    parts = [[0, 1, 3, 4, 5], [2], [0, 1, 2, 3, 4, 5]]
    for some in parts:
        value, gradient, z = likelihood.Laplace(together[some], 0.0, np.eye(4)).terms(thetas[:, 0], lower)
        for i, room in enumerate(some):
            want = [one_by_one(alone[room], t[0], m) for t, m in zip(thetas, lower, strict=True)]
            assert np.allclose(value[i], [v for v, _ in want], rtol=1e-9, atol=1e-7)
            assert np.allclose(z[i], [m for _, m in want], atol=1e-6)
        again = likelihood.Laplace(together[some], 0.0, np.eye(4)).terms(thetas[:, 0], lower, False)
        assert np.array_equal(again[0], value) and again[1] is None and np.isfinite(gradient).all()


def test_sets_close_together_take_two_evaluations(monkeypatch):
    """A room's patterns are gone through twice for a set near the first, not once for every step of a search from nothing."""
    rng = np.random.default_rng(4)
    alone = [room_of(rng, 4, 12) for _ in range(20)]
    together = likelihood.Rows(*(np.stack([getattr(r, c) for r in alone]) for c in ("x", "n", "k")))
    first = rng.normal(0, 0.7, 11)
    thetas = first + rng.normal(0, 0.003, (50, 11))
    near = likelihood.Laplace(together, first[0], likelihood.unpacked(first[1:], 4))
    seen, scores = [], likelihood.Laplace._scores
    monkeypatch.setattr(likelihood.Laplace, "_scores", lambda self, beta, some: seen.append(beta.shape[0] * beta.shape[2]) or scores(self, beta, some))
    near.terms(thetas[:, 0], likelihood.unpacked(thetas[:, 1:], 4), False)
    assert sum(seen) <= 2.2 * 50 * 20


def test_passes_over_rooms_run_in_all_tasks_and_repeat_to_the_last_bit(spark):
    """Rooms lie in as many parts as there are tasks, also where a shuffle has that number of parts anyway."""
    rows = sample(np.random.default_rng(6), 60, (0.8, 0.4), rows=6)
    frame = spark.createDataFrame(rows, "subject_room_id string, distance double, scv2_detected boolean")
    first, second = (rooms.fit_rooms(frame.orderBy(order), Design(("distance",)), rounds=2) for order in ("distance", "subject_room_id"))
    tasks = spark.sparkContext.defaultParallelism
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == tasks > 1
    assert first.tables()[0][0].rdd.getNumPartitions() == tasks
    assert np.array_equal(first.theta, second.theta) and first.history == second.history


def test_normal_rows_equal_the_dense_density():
    rng = np.random.default_rng(3)
    x, y = np.c_[np.ones(20), rng.normal(size=(20, 2))], rng.normal(1, 2, 20)
    theta = rng.normal(0, 0.6, (4, 8))
    at = lambda t: likelihood.gaussian_terms(x.T @ x, x.T @ y, 20.0, y.sum(), y @ y, t[:, 0], likelihood.unpacked(t[:, 1:-1], 3), np.exp(t[:, -1]))
    value, gradient, _, _ = at(theta)
    for i, t in enumerate(theta):
        lower = likelihood.unpacked(t[1:-1], 3)
        cover = x @ lower @ lower.T @ x.T + np.exp(2 * t[-1]) * np.eye(20)
        left = y - t[0]
        assert math.isclose(value[i], -0.5 * left @ np.linalg.solve(cover, left) - 0.5 * np.linalg.slogdet(cover)[1] - 10 * math.log(2 * math.pi), rel_tol=1e-9)
    numeric = np.array([(at(theta + 1e-5 * e)[0] - at(theta - 1e-5 * e)[0]) / 2e-5 for e in np.eye(8)]).T
    assert np.allclose(gradient, numeric, atol=1e-5)


def sample(rng, rooms_, slopes, rows=14):
    out = []
    for room in range(rooms_):
        u = rng.normal(size=2) * slopes
        for i in range(rows):
            eta = 0.4 + u[0] + u[1] * (i % 4 - 1.5)
            out.append((f"r{room}", float(i % 4 - 1.5), bool(rng.random() < 1 / (1 + math.exp(-eta)))))
    return out


def listed(rows, p):
    found = {}
    for room, x, y in rows:
        n, k = found.setdefault(room, {}).get(x, (0, 0))
        found[room][x] = (n + 1, k + y)
    return [likelihood.Rows(np.array([[1.0, x][:p] for x in f]), np.array([v[0] for v in f.values()], float), np.array([v[1] for v in f.values()], float)) for f in found.values()]


@pytest.mark.parametrize("p", [1, 2])
def test_fit_is_the_dense_optimum_of_twenty_rooms(spark, p):
    rows = sample(np.random.default_rng(21), 20, (0.9, 0.5))
    frame = spark.createDataFrame(rows, "subject_room_id string, distance double, scv2_detected boolean")
    fit = rooms.fit_rooms(frame, Design(("distance",) if p == 2 else ()))
    assert fit.converged and fit.passes <= 40
    parts = listed(rows, p)
    posterior = lambda t: sum(dense(r, t) for r in parts) - 0.5 * (t**2).sum()
    at, d = posterior(fit.theta), len(fit.theta)
    assert math.isclose(fit.history[-1], at, abs_tol=1e-5)
    for e in np.eye(d):
        # A quadratic through three points has its top at the fit.
        low, high = posterior(fit.theta - 0.02 * e), posterior(fit.theta + 0.02 * e)
        assert low < at and high < at and abs(0.5 * (low - high) / (low - 2 * at + high)) * 0.02 < 2e-3


def test_rooms_without_effects_have_no_spread(spark):
    rng = np.random.default_rng(12)
    frame = spark.createDataFrame([(f"r{i % 12}", bool(rng.random() < 0.5)) for i in range(900)], "subject_room_id string, scv2_detected boolean")
    fit = rooms.fit_rooms(frame, Design(()))
    assert fit.converged and fit.spread[0, 0] < 0.05 and fit.effects.count() == 12


def test_large_rooms_are_never_listed_and_give_the_same_fit(spark):
    rng = np.random.default_rng(8)
    rows = [(f"r{room}", float(x), bool(i % 2), bool(rng.random() < 1 / (1 + math.exp(-0.3 - level - 0.4 * x))))
            for room in range(24) for level in [rng.normal()] for i, x in enumerate(rng.normal(size=90 if room < 6 else 9))]
    rows += [("r23", 5.0, True, True)] * 40
    frame = spark.createDataFrame(rows, "subject_room_id string, distance double, high_touch boolean, scv2_detected boolean")
    design = Design(("distance", "high_touch"))
    whole, cut = (rooms.fit_rooms(frame, design, held=held) for held in (2000, 20))
    assert whole.converged and cut.converged
    assert np.allclose(whole.spread, cut.spread, atol=2e-3) and abs(whole.intercept - cut.intercept) < 1e-3
    first, second = ({r.subject_room_id: (r.u0, r.u1, r.v0_0, r.b0) for r in f.effects.collect()} for f in (whole, cut))
    assert first.keys() == second.keys() and all(np.allclose(first[k], second[k], atol=5e-3) for k in first)


@pytest.mark.parametrize("name", [n for n, m in catalog.MODELS.items() if m.room_level])
def test_given_models_converge(spark, name):
    fit = catalog.fit_model(name, views.swabs(spark, "/root/testdata/sf0.001"))
    assert fit.converged and fit.passes <= 40 and max(fit.history) == fit.history[-1]


def test_parameter_draws_have_the_posteriors_quantiles(spark):
    rows = sample(np.random.default_rng(31), 25, (0.8, 0.0))
    frame = spark.createDataFrame(rows, "subject_room_id string, distance double, scv2_detected boolean")
    fit = rooms.fit_rooms(frame, Design(()))
    draws, weights, size = rooms.parameter_draws(fit, 2000)
    assert draws.columns == ["draw", *rooms.parameter_names(fit)] == ["draw", "b_Intercept", "sd_subject_room_id__Intercept"]
    assert 1000 < size <= 2000
    got = draws.join(weights, "draw").toPandas()
    parts = listed(rows, 1)
    b, s = np.linspace(-0.6, 1.6, 45), np.linspace(0.0, 2.2, 45)
    logp = np.array([[sum(dense(r, np.array([x, y])) for r in parts) - 0.5 * (x * x + y * y) for y in s] for x in b])
    grid = np.exp(logp - logp.max())
    for name, axis, mass in (("b_Intercept", b, grid.sum(axis=1)), ("sd_subject_room_id__Intercept", s, grid.sum(axis=0))):
        mean = (axis * mass).sum() / mass.sum()
        sd = math.sqrt((axis**2 * mass).sum() / mass.sum() - mean**2)
        w = got["weight"].to_numpy()
        assert abs((got[name] * w).sum() - mean) < 0.15 * sd
        assert abs(math.sqrt(((got[name] - mean) ** 2 * w).sum()) / sd - 1) < 0.15


def test_draws_of_normal_rows_have_sigma_and_share(spark):
    rng = np.random.default_rng(5)
    rows = [(f"r{r}", float(np.exp(2 + level + 0.5 * rng.normal())) if i % 3 else None) for r in range(15) for level in [rng.normal()] for i in range(12)]
    frame = spark.createDataFrame(rows, "subject_room_id string, copies_max double")
    fit = rooms.fit_rooms_lognormal(frame, Design(()))
    draws, _, _ = rooms.parameter_draws(fit, 400)
    found = draws.toPandas()
    assert abs(found["sigma"].mean() - fit.sigma) < 0.05 and abs(found["hu"].mean() - 1 / 3) < 0.02 and (found["sd_subject_room_id__Intercept"] >= 0).all()


def test_scores_of_left_out_rooms_equal_refits(spark):
    rows = sample(np.random.default_rng(41), 10, (1.0, 0.0), rows=8)
    frame = spark.createDataFrame(rows, "subject_room_id string, distance double, scv2_detected boolean")
    fit = rooms.fit_rooms(frame, Design(()))
    got = {r.subject_room_id: r for r in rooms.leave_room_out(fit, 2000).collect()}
    names = list(dict.fromkeys(r[0] for r in rows))
    parts = dict(zip(names, listed(rows, 1), strict=True))
    b, s = np.linspace(-2.5, 3.5, 49), np.linspace(0.0, 4.0, 49)
    each = {k: np.array([[dense(r, np.array([x, y])) for y in s] for x in b]) for k, r in parts.items()}
    prior, off = -0.5 * (b[:, None] ** 2 + s[None, :] ** 2), {}
    for name in names:
        # The posterior of the other rooms, as a fit without this one would have it.
        others = prior + sum(v for k, v in each.items() if k != name)
        mass = np.exp(others - others.max())
        elpd = math.log((mass * np.exp(each[name])).sum() / mass.sum())
        off[name] = (abs(got[name].elpd - elpd), got[name].shape)
    print(off)
    # A room that says much of the spread has a heavy tail, and the shape says so.
    assert all(gap < (0.05 if shape < 0.7 else 0.25) for gap, shape in off.values()) and sum(shape < 0.7 for _, shape in off.values()) >= 7


@pytest.mark.parametrize("family", ["bernoulli", "hurdle_lognormal"])
def test_medians_of_rooms_are_those_of_their_draws_and_no_draw_is_a_row(spark, family):
    from pyspark.sql import functions as F

    rows = [(f"r{r}", float(i % 4), bool((i + r) % 3), float(1 + (i * 7 + r) % 11) if i % 3 else None) for r in range(6) for i in range(12)]
    frame = spark.createDataFrame(rows, "subject_room_id string, distance double, scv2_detected boolean, copies_max double")
    fit = (rooms.fit_rooms if family == "bernoulli" else rooms.fit_rooms_lognormal)(frame, Design(("distance",)))
    grid = frame.select("subject_room_id", "distance").distinct()
    got = rooms.room_medians(fit, grid, 201)
    eta = F.expr("b0 + b1 * distance")
    value = 1 / (1 + F.exp(-eta)) if family == "bernoulli" else (1 - F.col("hu")) * F.exp(eta + F.col("sigma") ** 2 / 2)
    want = grid.join(rooms.room_draws(fit, 201), "subject_room_id").groupBy("subject_room_id", "distance").agg(F.median(value).alias("m"))
    found = {(r.subject_room_id, r.distance): r.epred for r in got.collect()}
    expected = {(r.subject_room_id, r.distance): r.m for r in want.collect()}
    assert found.keys() == expected.keys() and all(math.isclose(found[k], v, rel_tol=1e-9) for k, v in expected.items())
    assert rooms.room_curves(fit, grid, 201).count() == 201 * len(found)
    # Draws are made after the join: what could be sent to every task is a row for each room.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan
