"""Draw diagnostics, predictive checks, leave-one-out scores and model comparison."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.operators.joins import keyed_join
from tracelight.plans.design import Design, linear_predictor
from tracelight.plans.draws import draw_matrix, pair_with_draws
from tracelight.session import cut_lineage

# Thresholds of the sampler checks.
RHAT_LIMIT = 1.1
EBFMI_LIMIT = 0.2
TREE_DEPTH_LIMIT = 10
SHAPE_LIMIT = 0.7


def chain_convergence(draws: DataFrame, split: bool = False) -> DataFrame:
    """Between/within chain variance ratio per parameter.

    ``split=True`` halves every chain at its middle iteration.
    """
    keys = ["model_name", "param"]
    chains = ["chain"]
    if split:
        span = draws.groupBy("model_name", "chain").agg(
            ((F.min("iteration") + F.max("iteration")) / 2).alias("_middle")
        )
        draws = keyed_join(draws, span, ["model_name", "chain"]).withColumn(
            "_half", F.col("iteration") > F.col("_middle")
        )
        chains = ["chain", "_half"]
    per_chain = draws.groupBy(*keys, *chains).agg(
        F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.count(F.lit(1)).alias("n")
    )
    pooled = per_chain.groupBy(*keys).agg(
        F.avg("var").alias("within"), F.var_samp("mean").alias("between"), F.avg("n").alias("n")
    )
    ratio = ((F.col("n") - 1) / F.col("n") * F.col("within") + F.col("between")) / F.nullif("within", F.lit(0.0))
    return pooled.select(*keys, F.sqrt(ratio).alias("rhat")).withColumn("converged", F.col("rhat") < RHAT_LIMIT)


def energy_fraction(steps: DataFrame) -> DataFrame:
    """E-BFMI per chain from (model_name, chain, iteration, energy).

    Consecutive iterations meet in an equi-join, so a long chain is not sorted in
    one task.
    """
    keys = ["model_name", "chain"]
    before = steps.select(
        *keys, (F.col("iteration") + 1).alias("iteration"), F.col("energy").alias("_before")
    )
    moves = steps.join(before, [*keys, "iteration"]).groupBy(*keys).agg(
        F.sum(F.pow(F.col("energy") - F.col("_before"), 2)).alias("moved")
    )
    spread = steps.groupBy(*keys).agg((F.var_samp("energy") * (F.count("energy") - 1)).alias("spread"))
    return keyed_join(moves, spread, keys).select(
        *keys, (F.col("moved") / F.nullif("spread", F.lit(0.0))).alias("ebfmi")
    ).withColumn("mixing", F.col("ebfmi") > EBFMI_LIMIT)


def sampler_warnings(steps: DataFrame) -> DataFrame:
    """Counts of divergent steps and of steps at the tree-depth limit per model."""
    return steps.groupBy("model_name").agg(
        F.count_if("divergent").alias("divergences"),
        F.count_if(F.col("treedepth") >= TREE_DEPTH_LIMIT).alias("depth_hits"),
        F.count(F.lit(1)).alias("steps"),
    )


def predictive_check(
    rows: DataFrame, key: str, draws: DataFrame, design: Design, count: int = 10,
    outcome: str = "scv2_detected",
) -> DataFrame:
    """Share detected per simulated data set next to the observed share.

    ``key`` identifies a row; it seeds the simulation, so a retried task repeats it.
    """
    used = rows.select(key, outcome, *design.columns).dropna()
    paired = pair_with_draws(used, draws, count)
    eta = linear_predictor([F.col(f"b{i}") for i in range(len(design.parameters))], design)
    u = F.pmod(F.xxhash64(F.col(key), F.col("draw")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    simulated = (u < 1.0 / (1.0 + F.exp(-eta))).cast("double")
    return paired.groupBy("draw").agg(
        F.avg(simulated).alias("simulated"), F.avg(F.col(outcome).cast("double")).alias("observed")
    )


def quantity_check(
    rows: DataFrame, key: str, draws: DataFrame, design: Design, edges: tuple[float, float, int],
    count: int = 10, quantity: str = "copies_max",
) -> DataFrame:
    """Histogram of log10 quantity, observed (draw -1) and per simulated data set.

    ``edges`` is (low, high, bins); values outside fall in bins 0 and bins + 1.
    """
    from tracelight.functions import inverse_normal

    low, high, bins = edges
    used = rows.select(key, quantity, *design.columns).dropna(subset=design.columns)
    paired = pair_with_draws(used, draws, count)
    mu = linear_predictor([F.col(f"b{i}") for i in range(len(design.parameters))], design)

    def uniform(salt: int):
        hashed = F.pmod(F.xxhash64(F.col(key), F.col("draw"), F.lit(salt)), F.lit(1 << 52))
        return (hashed + 0.5) / F.lit(float(1 << 52))

    drawn = (mu + F.col("sigma") * inverse_normal(uniform(1))) / F.lit(float(np.log(10.0)))
    simulated = paired.where(uniform(0) >= F.col("hu")).select("draw", drawn.alias("x"))
    observed = used.where(F.col(quantity) > 0).select(F.lit(-1).cast("bigint").alias("draw"), F.log10(quantity).alias("x"))
    return (
        simulated.unionByName(observed)
        .withColumn("bin", F.width_bucket("x", F.lit(float(low)), F.lit(float(high)), F.lit(bins)))
        .groupBy("draw", "bin").agg(F.count(F.lit(1)).alias("count"))
    )


def shape_of_tail(excess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Generalised Pareto shape and scale per row of sorted positive exceedances.

    Weighted average over a grid of candidate scales (Zhang and Stephens), with
    the usual weak prior that pulls the shape towards one half.
    """
    rows, count = excess.shape
    grid = 30 + int(np.sqrt(count))
    steps = np.arange(1, grid + 1)
    quarter = np.maximum(excess[:, int(count / 4 + 0.5) - 1], 1e-300)
    top = np.maximum(excess[:, -1], 1e-300)
    theta = (1 - np.sqrt(grid / (steps - 0.5)))[None, :] / (3 * quarter[:, None]) + 1 / top[:, None]
    shape = np.log1p(-theta[:, :, None] * excess[:, None, :]).mean(axis=2)
    ratio = np.where(np.abs(shape) < 1e-300, 1e-300, shape)
    profile = count * (np.log(np.maximum(-theta / ratio, 1e-300)) - shape - 1)
    weights = np.exp(profile - profile.max(axis=1, keepdims=True))
    weights /= weights.sum(axis=1, keepdims=True)
    best = (theta * weights).sum(axis=1)
    k = np.log1p(-best[:, None] * excess).mean(axis=1)
    scale = -k / best
    return (count * k + 10 * 0.5) / (count + 10), scale


def smoothed_scores(loglik: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leave-one-out score and tail shape for rows of per-draw log likelihoods."""
    rows, draws = loglik.shape
    logw = -loglik + loglik.min(axis=1, keepdims=True)
    tail = int(min(0.2 * draws, 3 * np.sqrt(draws)))
    shapes = np.full(rows, -np.inf)
    if tail >= 5:
        # Only the tail is put in order.
        order = np.argpartition(logw, draws - tail - 1, axis=1)[:, draws - tail - 1 :]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(logw, order, axis=1), axis=1), axis=1)
        ranked = np.take_along_axis(logw, order, axis=1)
        cut = ranked[:, -tail - 1]
        varied = ranked[:, -1] - cut > 1e-10
        if varied.any():
            excess = np.exp(ranked[varied, -tail:]) - np.exp(cut[varied])[:, None]
            excess = np.maximum(excess, 1e-300)
            k, scale = shape_of_tail(excess)
            p = (np.arange(1, tail + 1) - 0.5) / tail
            k_safe = np.where(np.abs(k) < 1e-12, 1e-12, k)[:, None]
            smooth = scale[:, None] * np.expm1(-k_safe * np.log1p(-p)[None, :]) / k_safe
            replaced = np.log(np.maximum(smooth + np.exp(cut[varied])[:, None], 1e-300))
            ranked[varied, -tail:] = np.minimum(replaced, ranked[varied, -1:])
            np.put_along_axis(logw, order, ranked, axis=1)
            shapes[varied] = k
    top = logw.max(axis=1, keepdims=True)
    total = np.log(np.exp(logw - top).sum(axis=1)) + top[:, 0]
    joint = logw + loglik
    high = joint.max(axis=1, keepdims=True)
    return np.log(np.exp(joint - high).sum(axis=1)) + high[:, 0] - total, shapes


def _log_likelihood(y: np.ndarray, x: np.ndarray, matrix: np.ndarray, family: str) -> np.ndarray:
    """Rows x draws; a hurdle matrix carries ``sigma`` and ``hu`` in its last two columns."""
    y = y[:, None]
    if family == "bernoulli":
        eta = x @ matrix.T
        return y * eta - np.logaddexp(0.0, eta)
    mu, sigma, hu = x @ matrix[:, :-2].T, matrix[None, :, -2], matrix[None, :, -1]
    logy = np.log(np.where(y > 0, y, 1.0))
    density = -0.5 * ((logy - mu) / sigma) ** 2 - np.log(sigma) - 0.5 * np.log(2 * np.pi) - logy
    return np.where(y > 0, np.log1p(-hu) + density, np.log(hu))


def plain_scores(y: np.ndarray, x: np.ndarray, matrix: np.ndarray, family: str) -> np.ndarray:
    """Leave-one-out score without smoothing: minus the log of the mean of 1 / likelihood over the draws.

    With y of 0 or 1 and odds e^z against it, 1 / likelihood is 1 + e^z: one exponential a draw.
    """
    binary = family == "bernoulli"
    if binary and not ((y == 0) | (y == 1)).all():
        raise ValueError("outcomes of a bernoulli model must be 0 or 1")
    low = (x * (1 - 2 * y)[:, None]) @ matrix.T if binary else -_log_likelihood(y, x, matrix, family)
    top = low.max(axis=1, keepdims=True)
    low -= top
    mean = np.log(np.exp(low, out=low).mean(axis=1)) + top[:, 0]
    return -np.logaddexp(0.0, mean) if binary else -mean


def leave_one_out(
    counts: DataFrame, columns: Sequence[str], draws: DataFrame, design: Design, smooth: bool = True,
    family: str = "bernoulli",
) -> DataFrame:
    """Leave-one-out score of every distinct (covariates, outcome) row.

    ``counts`` has ``columns``, outcome ``y`` (0/1, or the quantity with zero for
    undetected of a hurdle lognormal) and weight ``n``. Repeated
    observations share their score, so they are scored once. The draws (a bounded
    matrix) travel to the rows; nothing is shuffled. Without smoothing the score
    is the plain importance-sampling estimate.
    """
    p = len(design.parameters)
    matrix = draw_matrix(draws, p, () if family == "bernoulli" else ("sigma", "hu"))
    expressions = [c.alias(f"_x{i}") for i, c in enumerate(design.expressions().values())]
    rows = counts.select(*columns, "y", "n", *expressions)
    fields = [f for f in rows.schema.fields if not f.name.startswith("_x")]
    names = [f.name for f in fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                x = part[[f"_x{i}" for i in range(p)]].to_numpy(float)
                y = part["y"].to_numpy(float)
                if smooth:
                    elpd, shape = smoothed_scores(_log_likelihood(y, x, matrix, family))
                else:
                    elpd, shape = plain_scores(y, x, matrix, family), np.full(len(part), np.nan)
                yield part[names].assign(elpd=elpd, shape=shape)

    return rows.mapInPandas(score, f"{schema}, elpd double, shape double")


def score_totals(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total score, its standard error and the number of unreliable tails, per key."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("elpd")) / n
    square = F.sum(F.col("n") * F.col("elpd") * F.col("elpd"))
    variance = (square - n * mean * mean) / F.nullif(n - 1, F.lit(0))
    return scores.groupBy(*keys).agg(
        (n * mean).alias("elpd_loo"),
        F.when(n > 1, F.sqrt(n * F.greatest(variance, F.lit(0.0)))).alias("se_elpd_loo"),
        F.sum(F.when(F.col("shape") > SHAPE_LIMIT, F.col("n")).otherwise(0)).alias("bad_tails"),
    )


def compare_models(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Difference to the best model, ranked: ``elpd_diff`` and its standard error.

    ``scores`` has ``model_name``, ``keys`` (same rows for every model), weight
    ``n`` and ``elpd``. They are written once: three steps read them, and scoring
    is the costly part. Models that score other rows or weights than the best
    cannot be compared: that is an error.
    """
    scores = cut_lineage(scores)
    totals = scores.groupBy("model_name").agg(F.sum(F.col("n") * F.col("elpd")).alias("elpd_loo"))
    best = totals.agg(F.max_by("model_name", F.struct("elpd_loo", "model_name"))).scalar()
    top = scores.where(F.col("model_name") == best).select(*keys, F.col("elpd").alias("_best"), F.col("n").alias("_n"), F.lit(1).alias("_top"))
    paired = keyed_join(scores, top, keys).withColumn("_d", F.col("elpd") - F.col("_best"))
    sizes = paired.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count("_top").alias("met"), F.count_if(F.col("n") != F.col("_n")).alias("other"))
    whole = top.count()
    wrong = sizes.where((F.col("rows") != whole) | (F.col("met") != whole) | (F.col("other") > 0)).orderBy("model_name").collect()
    if wrong:
        raise ValueError("rows or weights differ from the best model's: " + ", ".join(r["model_name"] for r in wrong))
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("_d")) / n
    variance = (F.sum(F.col("n") * F.col("_d") * F.col("_d")) - n * mean * mean) / F.nullif(n - 1, F.lit(0))
    return paired.groupBy("model_name").agg(
        (n * mean).alias("elpd_diff"),
        F.when(n > 1, F.sqrt(n * F.greatest(variance, F.lit(0.0)))).alias("se_diff"),
        F.sum(F.col("n") * F.col("elpd")).alias("elpd_loo"),
    ).withColumn("rank", F.rank().over(Window.orderBy(F.col("elpd_diff").desc())))
