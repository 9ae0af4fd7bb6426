"""Diagnostics of draws against plain loops."""

import math

import numpy as np

from tracelight.functions.normal import inverse_normal_array
from tracelight.plans import mixing

KIND = "model_name string, chain int, iteration long, param string, value double"


def chains(seed, n, rho, shift=0.0, many=4):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(many):
        x = np.zeros(n)
        x[0] = rng.normal()
        for i in range(1, n):
            x[i] = rho * x[i - 1] + math.sqrt(1 - rho**2) * rng.normal()
        out.append(x + shift * c)
    return out


def frame_of(spark, **params):
    rows = [("m", c, i, name, float(v)) for name, many in params.items() for c, x in enumerate(many) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, KIND)


def ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def scores(parts):
    flat = np.concatenate(parts)
    z = inverse_normal_array((ranks(flat) - 0.375) / (len(flat) + 0.25))
    return np.split(z, np.cumsum([len(p) for p in parts])[:-1])


def halves(parts):
    return [h for x in parts for h in (x[: math.ceil(len(x) / 2)], x[math.ceil(len(x) / 2) :])]


def variances(parts):
    n = np.mean([len(p) for p in parts])
    within = np.mean([np.var(p, ddof=1) for p in parts])
    return within, (n - 1) / n * within + np.var([np.mean(p) for p in parts], ddof=1)


def size(parts):
    within, total = variances(parts)
    n, draws = min(map(len, parts)), sum(map(len, parts))
    if total <= 0:
        return None
    acov = [np.mean([sum((p[i] - p.mean()) * (p[i + t] - p.mean()) for i in range(len(p) - t)) / len(p) for p in parts]) for t in range(n)]
    rho = [1.0] + [1 - (within - acov[t]) / total for t in range(1, n)]
    time, least = -1.0, math.inf
    for k in range(n // 2):
        least = min(least, rho[2 * k] + rho[2 * k + 1])
        if least <= 0:
            break
        time += 2 * least
    return draws / max(time, 1 / math.log10(draws))


def test_ranks_share_their_mean(spark):
    frame = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 3.0, None, 2.0, 3.0)] + [(None, 1.0), (None, 1.0)], "g string, v double")
    got = sorted(((r.g or "", r.v or 0.0, r["rank"], r.n) for r in mixing.average_ranks(frame, ["g"], "v").collect()), key=repr)
    assert got == sorted([("", 1.0, 1.5, 2)] * 2 + [("a", 0.0, None, 5), ("a", 1.0, 1.0, 5), ("a", 2.0, 2.0, 5)] + [("a", 3.0, 4.0, 5)] * 3, key=repr)


def test_convergence_and_sizes_are_those_of_plain_loops(spark):
    params = {
        "free": chains(1, 120, 0.0), "slow": chains(2, 121, 0.9), "apart": chains(3, 80, 0.2, 3.0), "back": chains(4, 100, -0.6),
        "ties": [np.round(x) for x in chains(5, 90, 0.5)], "wide": [x * (1 + 4 * (c % 2)) for c, x in enumerate(chains(6, 100, 0.0))],
    }
    for name, parts in params.items():  # halves are cut by chain, so one frame for each length
        frame = frame_of(spark, **{name: parts})
        split = halves(parts)
        z = scores(split)
        middle = np.median(np.concatenate(split))
        folded = scores([np.abs(p - middle) for p in split])
        ratio = max(math.sqrt(t / w) for w, t in (variances(z), variances(folded)))
        got = mixing.rank_convergence(frame).collect()
        assert len(got) == 1 and math.isclose(got[0].rhat, ratio, rel_tol=1e-6) and got[0].converged == (ratio < 1.1)
        limits = np.quantile(np.concatenate(split), [0.05, 0.95])
        tails = [size([(p <= q).astype(float) for p in split]) for q in limits]
        found = mixing.effective_sizes(frame).collect()[0]
        assert math.isclose(found.ess_bulk, size(z), rel_tol=1e-6), name
        expected = [t for t in tails if t is not None]
        assert math.isclose(found.ess_tail, min(expected), rel_tol=1e-6), name


def test_what_the_diagnostics_say(spark):
    frame = frame_of(spark, free=chains(11, 400, 0.0), slow=chains(12, 400, 0.95), apart=chains(13, 400, 0.0, 2.0))
    ratio = {r.param: r.converged for r in mixing.rank_convergence(frame).collect()}
    sizes = {r.param: r.ess_bulk for r in mixing.effective_sizes(frame).collect()}
    assert ratio["free"] and not ratio["apart"]
    assert 1000 < sizes["free"] < 2500 and sizes["slow"] < 200 and sizes["apart"] < 30


def test_constant_and_missing_draws(spark):
    frame = frame_of(spark, same=[np.ones(20)] * 4)
    assert mixing.rank_convergence(frame).collect()[0].rhat is None
    assert mixing.effective_sizes(frame).collect()[0].ess_bulk is None
    assert mixing.effective_sizes(frame.where("chain < 0")).count() == 0
