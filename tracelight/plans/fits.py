"""Fits from distributed sums; only p x p matrices reach the driver."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions import is_detected
from tracelight.plans.design import Design, bernoulli_patterns, design_columns

PRIOR_SD = 10.0
MAX_STEPS = 25
STEP_LIMIT = 1e-8


@dataclass
class Fit:
    """Coefficients and their covariance, with the residual scale and hurdle share if any."""

    design: Design
    family: str
    beta: np.ndarray
    covariance: np.ndarray
    sigma: float | None = None
    hurdle: float | None = None
    rows: float = 0.0
    iterations: int = 0
    converged: bool = True

    def table(self, spark: SparkSession, model_name: str) -> DataFrame:
        """(model_name, param, estimate, est_error) rows."""
        errors = np.sqrt(np.diag(self.covariance))
        rows = [
            (model_name, p, float(b), float(e))
            for p, b, e in zip(self.design.parameters, self.beta, errors)
        ]
        for name, value in (("sigma", self.sigma), ("hu", self.hurdle)):
            if value is not None:
                rows.append((model_name, name, float(value), None))
        return spark.createDataFrame(rows, "model_name string, param string, estimate double, est_error double")


def _triangle(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _symmetric(values: Sequence[float], p: int) -> np.ndarray:
    matrix = np.zeros((p, p))
    for (i, j), value in zip(_triangle(p), values):
        matrix[i, j] = matrix[j, i] = value
    return matrix


def with_predictor(rows: DataFrame, betas: dict[tuple, np.ndarray], keys: Sequence[str]) -> DataFrame:
    """Add ``_eta``, the linear predictor at the coefficients of the row's stratum."""

    def dot(beta: np.ndarray) -> Column:
        return F.expr(" + ".join(f"({float(b)!r}D) * x{i}" for i, b in enumerate(beta)))

    if not keys:
        return rows.withColumn("_eta", dot(betas[()]))
    eta = F.lit(None).cast("double")
    for key, beta in betas.items():
        same = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(keys, key)])
        eta = F.when(same, dot(beta)).otherwise(eta)
    return rows.withColumn("_eta", eta)


# Pieces of the bernoulli score at ``_eta``: mean, residual, weight, ln(1 + e^eta).
SCORE = {
    "_m": "1 / (1 + exp(-_eta))",
    "_r": "k - n / (1 + exp(-_eta))",
    "_w": "n / (1 + exp(-_eta)) / (1 + exp(_eta))",
    "_softplus": "greatest(_eta, 0D) + log1p(exp(-abs(_eta)))",
}


def score_sums(p: int) -> list[Column]:
    """Gradient ``g<i>``, information ``h<i>_<j>``, log likelihood and trials."""
    sums = [f"sum(_r * x{i}) AS g{i}" for i in range(p)]
    sums += [f"sum(_w * x{i} * x{j}) AS h{i}_{j}" for i, j in _triangle(p)]
    sums += ["sum(k * _eta - n * _softplus) AS loglik", "sum(n) AS rows"]
    return [F.expr(text) for text in sums]


def with_score(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("*", *[f"{text} AS {name}" for name, text in SCORE.items()])


def bernoulli_sums(patterns: DataFrame, betas: dict, p: int, keys: Sequence[str] = ()) -> dict:
    """Gradient, information and log likelihood at the given coefficients.

    ``betas`` maps a key tuple (``()`` without keys) to its coefficients. One
    aggregate per call; partial sums are formed before the shuffle.
    """
    rows = with_score(with_predictor(patterns, betas, keys))
    out = {}
    for row in rows.groupBy(*keys).agg(*score_sums(p)).collect():
        key = tuple(row[k] for k in keys)
        gradient = np.array([row[f"g{i}"] for i in range(p)])
        information = _symmetric([row[f"h{i}_{j}"] for i, j in _triangle(p)], p)
        out[key] = (gradient, information, row["loglik"], row["rows"])
    return out


def fit_bernoulli(
    frame: DataFrame,
    design: Design,
    outcome: str = "scv2_detected",
    keys: Sequence[str] = (),
    prior_sd: float | None = PRIOR_SD,
    max_steps: int = MAX_STEPS,
) -> dict[tuple, Fit]:
    """Logistic regression by Newton steps on the covariate patterns.

    ``keys`` fits every stratum of a few-valued key in the same passes. A normal
    prior of ``prior_sd`` keeps separated cells finite; ``None`` is maximum
    likelihood.
    """
    patterns = bernoulli_patterns(frame, design, outcome, keys).persist(StorageLevel.MEMORY_AND_DISK)
    p = len(design.parameters)
    precision = np.zeros((p, p)) if prior_sd is None else np.eye(p) / prior_sd**2
    try:
        strata = [tuple(r) for r in patterns.select(*keys).distinct().collect()] if keys else [()]
        betas = {key: np.zeros(p) for key in strata}
        for step in range(1, max_steps + 1):
            sums = bernoulli_sums(patterns, betas, p, keys)
            largest = 0.0
            for key, (gradient, information, _, _) in sums.items():
                move = np.linalg.solve(information + precision, gradient - precision @ betas[key])
                betas[key] = betas[key] + move
                largest = max(largest, float(np.max(np.abs(move))))
            if largest < STEP_LIMIT:
                break
        else:
            warnings.warn(f"the largest step after {max_steps} is {largest:.2g}: not converged", stacklevel=2)
    finally:
        patterns.unpersist()
    return {
        key: Fit(design, "bernoulli", betas[key], np.linalg.inv(h + precision), rows=n, iterations=step, converged=largest < STEP_LIMIT)
        for key, (_, h, _, n) in sums.items()
    }


def least_squares(
    frame: DataFrame, design: Design, outcome: Column, keys: Sequence[str] = (), prior_sd: float = PRIOR_SD
) -> dict[tuple, Fit]:
    """Linear regression from one aggregate of cross products.

    A second pass takes the residuals at that solution, corrects the
    coefficients by their remaining gradient and sums the squares: differences
    of large totals would lose digits on long tables.

    A stratum that cannot carry its own line (no rows to spare, or covariates
    without spread) takes the residual scale of the others and a normal prior of
    ``prior_sd``, so every stratum is returned.
    """
    rows = frame.select(*dict.fromkeys([*keys, *design.columns]), outcome.alias("_y")).dropna()
    rows = design_columns(rows, design, keep=[*keys, "_y"])
    p = len(design.parameters)
    first = [F.expr(f"sum(x{i} * x{j}) AS s{i}_{j}") for i, j in _triangle(p)]
    first += [F.expr(f"sum(x{i} * _y) AS m{i}") for i in range(p)]
    cross, moments, betas, counts, own = {}, {}, {}, {}, {}
    for row in rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *first).collect():
        key = tuple(row[k] for k in keys)
        if not row["n"]:
            continue
        cross[key] = _symmetric([row[f"s{i}_{j}"] for i, j in _triangle(p)], p)
        moments[key], counts[key] = np.array([row[f"m{i}"] for i in range(p)]), row["n"]
        own[key] = row["n"] > p and _well_posed(cross[key])
        betas[key] = np.linalg.solve(cross[key], moments[key]) if own[key] else np.linalg.pinv(cross[key]) @ moments[key]
    if not betas:
        return {}
    residuals = with_predictor(rows, betas, keys).withColumn("_e", F.col("_y") - F.col("_eta"))
    second = [F.sum(F.col("_e") * F.col(f"x{i}")).alias(f"g{i}") for i in range(p)]
    second.append(F.sum(F.col("_e") * F.col("_e")).alias("ss"))
    sums = {tuple(row[k] for k in keys): row for row in residuals.groupBy(*keys).agg(*second).collect()}
    fits, squares, spare = {}, 0.0, 0
    for key in (k for k in betas if own[k]):
        gradient = np.array([sums[key][f"g{i}"] for i in range(p)])
        correction = np.linalg.solve(cross[key], gradient)
        ss = max(sums[key]["ss"] - float(gradient @ correction), 0.0)
        squares, spare = squares + ss, spare + counts[key] - p
        sigma = float(np.sqrt(ss / (counts[key] - p)))
        fits[key] = Fit(
            design, "gaussian", betas[key] + correction, sigma**2 * np.linalg.inv(cross[key]),
            sigma=sigma, rows=counts[key], iterations=1,
        )
    common = np.sqrt(squares / spare) if squares > 0 else 1.0
    for key in (k for k in betas if not own[k]):
        covariance = np.linalg.inv(cross[key] / common**2 + np.eye(p) / prior_sd**2)
        fits[key] = Fit(
            design, "gaussian", covariance @ moments[key] / common**2, covariance, sigma=float(common), rows=counts[key], iterations=1,
        )
    return fits


def _well_posed(matrix: np.ndarray) -> bool:
    """Whether a matrix of cross products can be solved, whatever its columns' scales."""
    scale = np.sqrt(np.diag(matrix))
    return bool(np.all(scale > 0)) and float(np.linalg.eigvalsh(matrix / np.outer(scale, scale))[0]) > 1e-10


def simple_lines(frame: DataFrame, x: str, y: Column, keys: Sequence[str]) -> DataFrame:
    """One-covariate regression per group, entirely in one aggregate."""
    rows = frame.select(*keys, F.col(x).cast("double").alias("x"), y.alias("y")).dropna()
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_slope("y", "x").alias("slope"),
        F.sqrt(
            F.greatest(F.regr_syy("y", "x") - F.pow(F.regr_sxy("y", "x"), 2) / F.regr_sxx("y", "x"), F.lit(0.0))
            / F.nullif(F.count(F.lit(1)) - 2, F.lit(0))
        ).alias("sigma"),
    )


def hurdle_lines(frame: DataFrame, x: str, keys: Sequence[str], quantity: str = "copies_max") -> DataFrame:
    """Hurdle lognormal per group: share of zeros and a line through ``ln(y)`` of the rest."""
    rows = frame.where(F.col(x).isNotNull())
    detected = is_detected(F.col(quantity)) & (F.col(quantity) > 0)
    y = F.when(detected, F.log(F.col(quantity)))
    v = F.when(detected, F.col(x).cast("double"))
    return rows.groupBy(*keys).agg(
        F.avg((~detected).cast("double")).alias("hu"),
        F.regr_intercept(y, v).alias("intercept"),
        F.regr_slope(y, v).alias("slope"),
        F.sqrt(
            F.greatest(F.regr_syy(y, v) - F.pow(F.regr_sxy(y, v), 2) / F.regr_sxx(y, v), F.lit(0.0))
            / F.nullif(F.count(y) - 2, F.lit(0))
        ).alias("sigma"),
    )


def lognormal_mean(mu: Column, sigma: Column, hu: Column) -> Column:
    """Expected value of a hurdle lognormal."""
    return (1.0 - hu) * F.exp(mu + sigma * sigma / 2.0)


def fit_hurdle(frame: DataFrame, design: Design, quantity: str = "copies_max", keys: Sequence[str] = ()) -> dict[tuple, Fit]:
    """Hurdle lognormal: the likelihood factorises into zeros and ``ln(y)`` of the rest."""
    used = frame.dropna(subset=design.columns) if design.columns else frame
    detected = is_detected(F.col(quantity)) & (F.col(quantity) > 0)
    zeros = used.groupBy(*keys).agg(F.avg((~detected).cast("double")).alias("hu"), F.count(F.lit(1)).alias("n"))
    shares = {tuple(r[k] for k in keys): (r["hu"], r["n"]) for r in zeros.collect()}
    fits = least_squares(used, design, F.when(detected, F.log(F.col(quantity))), keys)
    p = len(design.parameters)
    for key in (k for k, (_, n) in shares.items() if k not in fits and n):  # nothing detected: the prior alone
        common = float(np.mean([f.sigma for f in fits.values()])) if fits else 1.0
        fits[key] = Fit(design, "gaussian", np.zeros(p), np.eye(p) * PRIOR_SD**2, sigma=common)
    for key, fit in fits.items():
        fit.family = "hurdle_lognormal"
        fit.hurdle, fit.rows = shares[key]
    return fits


def cell_log_odds(frame: DataFrame, cells: Sequence[str], outcome: str = "scv2_detected") -> DataFrame:
    """Closed-form logistic fit of a saturated design: ``ln(k / (n - k))`` per cell."""
    counts = frame.dropna(subset=[outcome, *cells]).groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("bigint")).alias("k")
    )
    failures = F.nullif(F.col("n") - F.col("k"), F.lit(0))
    odds = F.nullif(F.col("k").cast("double"), F.lit(0.0)) / failures
    return counts.withColumn("log_odds", F.log(odds))
