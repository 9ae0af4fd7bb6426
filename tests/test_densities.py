"""Binned densities against plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from tracelight.plans import densities
from tracelight.plans.design import Design

LOW, HIGH, POINTS = -1.0, 3.0, 17
STEP = (HIGH - LOW) / (POINTS - 1)


def brute(values):
    weight = np.zeros(POINTS)
    for x in values:
        at = min(max((x - LOW) / STEP, 0.0), POINTS - 1.0)
        left = min(int(at), POINTS - 2)
        weight[left] += left + 1 - at
        weight[left + 1] += at - left
    grid = LOW + STEP * np.arange(POINTS)
    n, mean = weight.sum(), (weight * grid).sum() / weight.sum()
    h = max(0.9 * math.sqrt(max((weight * grid**2).sum() / n - mean**2, 0)) * n**-0.2, STEP)
    return weight, [(weight * np.exp(-0.5 * ((g - grid) / h) ** 2)).sum() / (h * n * math.sqrt(2 * math.pi)) for g in grid]


def test_bins_and_densities_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(1, 0.8, 300).tolist() + [-5.0, 9.0, LOW, HIGH], "b": [0.5] * 40, None: [2.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None)]
    frame = spark.createDataFrame(rows, "draw string, x double")
    binned = densities.linear_bins(frame, ["draw"], LOW, HIGH, POINTS)
    got = {}
    for r in densities.smoothed(binned, ["draw"], LOW, HIGH, POINTS).collect():
        got.setdefault(r.draw, {})[r.bin] = (r.weight, r.density)
    for key, vs in values.items():
        weight, density = brute(vs)
        assert np.allclose([got[key][i][0] for i in range(POINTS)], weight) and np.allclose([got[key][i][1] for i in range(POINTS)], density)
        assert math.isclose(sum(weight), len(vs))
    assert densities.smoothed(densities.linear_bins(frame.where("x > 99"), ["draw"], LOW, HIGH, POINTS), ["draw"], LOW, HIGH, POINTS).count() == 0


def test_simulated_data_sets_look_like_their_model(spark):
    rows = spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") % 2 == 0).alias("high_touch"), F.lit(50.0).alias("copies_max"))
    draws = spark.createDataFrame([(d, 2.0, 1.0, 0.6, 0.3) for d in range(3)], "draw long, b0 double, b1 double, sigma double, hu double")
    design = Design(("high_touch",))
    made = densities.simulated(densities.with_draws(rows, draws, 3), design, "event_id", "hurdle_lognormal").groupBy("draw").agg(
        F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev("x").alias("s")).collect()
    for r in made:
        assert abs(r.n / 4000 - 0.7) < 0.02 and abs(r.m * math.log(10) - 2.5) < 0.05
        assert abs(r.s * math.log(10) - math.sqrt(0.36 + 0.25)) < 0.05
    found = densities.density_check(rows, draws, design, "event_id", "hurdle_lognormal", (0.0, 4.0, 33), 3)
    total = {r.draw: (r.w, r.d) for r in found.groupBy("draw").agg(F.sum("weight").alias("w"), (F.sum("density") / 8).alias("d")).collect()}
    assert math.isclose(total[-1][0], 4000) and all(abs(d - 1) < 0.03 for _, d in total.values())
    again = densities.density_check(rows.repartition(7), draws, design, "event_id", "hurdle_lognormal", (0.0, 4.0, 33), 3)
    fine = lambda f: sorted((r.draw, r.bin, round(r.weight, 6), round(r.density, 6)) for r in f.collect())
    assert fine(again) == fine(found)


def test_more_draws_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(densities, "LOOKUP_ROWS", 0)
    rows = spark.createDataFrame([(i, f"r{i % 3}", float(i % 5), 10.0) for i in range(60)], "event_id long, room string, distance double, copies_max double")
    draws = spark.createDataFrame([(f"r{r}", d, 1.0, 0.1, 0.5) for r in range(3) for d in range(4)], "room string, draw long, b0 double, b1 double, sigma double")
    made = densities.with_draws(rows, draws, 4, ["room"])
    assert made.count() == 240 and made.columns.count("room") == 1


def regions(values, mass, points=129):
    """The same by plain loops."""
    x = np.array(values)
    low, wide = x.min() - 0.1 * (x.max() - x.min()), 1.2 * (x.max() - x.min())
    scaled = (x - low) / wide if wide > 0 else np.full(len(x), 0.5)
    weight, step = np.zeros(points), 1 / (points - 1)
    for v in scaled:
        left = min(int(v / step), points - 2)
        weight[left] += left + 1 - v / step
        weight[left + 1] += v / step - left
    grid = np.arange(points) * step
    n, mean = weight.sum(), (weight * grid).sum() / weight.sum()
    h = max(0.9 * math.sqrt(max((weight * grid**2).sum() / n - mean**2, 0)) * n**-0.2, step)
    density = np.array([(weight * np.exp(-0.5 * ((g - grid) / h) ** 2)).sum() for g in grid])
    density = np.round(density / density.max(), 12)
    order = sorted(range(points), key=lambda i: (-density[i], i))
    held, cut = 0.0, None
    for i in order:
        if held >= n * (mass - 1e-9):
            break
        held, cut = held + weight[i], density[i]
    out, i = [], 0
    while i < points:
        if density[i] >= cut:
            j = i
            while j + 1 < points and density[j + 1] >= cut:
                j += 1
            a = grid[i] - step * (density[i] - cut) / (density[i] - density[i - 1]) if i else grid[i]
            b = grid[j] + step * (density[j] - cut) / (density[j] - density[j + 1]) if j + 1 < points else grid[j]
            out.append((low + a * wide, low + b * wide, weight[i : j + 1].sum() / n))
            i = j
        i += 1
    return out


def test_two_modes_give_two_regions(spark):
    rng = np.random.default_rng(9)
    values = {
        "one": rng.normal(0, 1, 4000).tolist(), "two": [*rng.normal(-4, 0.5, 1500), *rng.normal(3, 0.8, 2500)], "same": [2.5] * 30, "few": [1.0, 2.0], None: [0.0, 0.0, 7.0],
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("one", None)]
    frame = spark.createDataFrame(rows, "g string, x double")
    got = {}
    for r in densities.density_regions(frame, ["g"], "x", 0.9).orderBy("region").collect():
        got.setdefault(r.g, []).append((r.lower, r.upper, r.share))
    for key, vs in values.items():
        assert np.allclose(got[key], regions(vs, 0.9), atol=1e-7), key
    assert len(got["one"]) == 1 and abs(got["one"][0][0] + 1.645) < 0.2 and abs(got["one"][0][1] - 1.645) < 0.2
    (a, b, _), (c, d, _) = got["two"]
    assert a < -4 < b < -2 < 1 < c < 3 < d and got["same"] == [(2.5, 2.5, got["same"][0][2])]
    inside = np.mean([any(lo <= v <= hi for lo, hi, _ in got["two"]) for v in values["two"]])
    assert abs(inside - 0.9) < 0.02


def test_simulated_quantiles_are_written_out_once(spark):
    """Written out for each use, the plan is too long to be compiled and each row costs a hundredfold."""
    from tracelight.plans import catalog

    rows = spark.range(50).selectExpr("id AS event_id", "id % 9 AS subject_covid_day")
    draws = spark.range(3).selectExpr("id AS draw", "0.1D AS b0", "0.2D AS b1", "1D AS sigma", "0.5D AS hu")
    design = catalog.MODELS["hurdle_time_mix_category"].design
    made = densities.simulated(densities.with_draws(rows, draws, 3), design, "event_id", "hurdle_lognormal")
    binned = densities.linear_bins(made, ["draw"], 0.0, 4.0, 33)
    plan = binned._jdf.queryExecution().optimizedPlan().toString()
    # 5 of them, and 167 where each use has a copy of its own.
    assert plan.count("event_id") < 20
    assert abs(binned.agg({"weight": "sum"}).first()[0] - made.count()) < 1e-9


def test_missing_values_have_no_weight(spark):
    rows = spark.createDataFrame([("a", 0.25), ("a", None), ("a", 9.0), ("b", None)], "k string, x double")
    found = {(r.k, r.bin): r.weight for r in densities.linear_bins(rows, ["k"], 0.0, 1.0, 3).collect()}
    assert found == {("a", 0): 0.5, ("a", 1): 0.5, ("a", 2): 1.0}
