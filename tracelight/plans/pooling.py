"""Partial pooling of a few stratum fits.

Each stratum estimate is shrunk to a common centre in proportion to its
precision; the spread between strata is estimated by moments. With two or three
strata that spread is weakly identified, so it is returned with the estimates.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tracelight.plans.extrapolate import Accelerated
from tracelight.plans.fits import Fit

#: A variance between strata below this share of the strata's own is none.
NO_SPREAD = 1e-4


@dataclass
class Pooled:
    """Pooled coefficients; ``spread`` is between strata (of one parent), ``upper`` between parents."""

    estimates: dict[tuple, np.ndarray]
    covariances: dict[tuple, np.ndarray]
    centre: np.ndarray
    spread: np.ndarray
    upper: np.ndarray | None = None
    converged: bool = True
    fits: dict[tuple, Fit] = field(default_factory=dict)

    def stratum(self, key: tuple) -> Fit:
        """The pooled fit of one stratum, with its own residual scale and hurdle share."""
        return replace(self.fits[key], beta=self.estimates[key], covariance=self.covariances[key])

    def table(self, spark: SparkSession, model_name: str, names: list[str]) -> DataFrame:
        """(model_name, stratum, param, estimate, est_error, spread_sd, parent_spread_sd); sigma and hu have an estimate alone."""
        sds = np.sqrt(np.clip(np.diag(self.spread), 0.0, None))
        above = None if self.upper is None else np.sqrt(np.clip(np.diag(self.upper), 0.0, None))
        rows = []
        for key in sorted(self.estimates, key=str):
            errors = np.sqrt(np.diag(self.covariances[key]))
            label = "/".join(str(k) for k in key)
            for i, name in enumerate(names):
                parent = None if above is None else float(above[i])
                rows.append((model_name, label, name, float(self.estimates[key][i]), float(errors[i]), float(sds[i]), parent))
            for name, value in (("sigma", self.fits[key].sigma), ("hu", self.fits[key].hurdle)):
                if value is not None:
                    rows.append((model_name, label, name, float(value), None, None, None))
        schema = "model_name string, stratum string, param string, estimate double, est_error double, spread_sd double, parent_spread_sd double"
        return spark.createDataFrame(rows, schema)


def _positive(matrix: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.clip(values, floor, None)) @ vectors.T


def pool(fits: dict[tuple, Fit], centre: np.ndarray | None = None, rounds: int = 5_000, tolerance: float = 1e-7) -> Pooled:
    """Shrink stratum fits to ``centre``, or to their precision-weighted mean if None.

    Rounds (every second one extrapolated) go on until a plain step moves the spread
    by less than ``tolerance`` of its size, or until no spread is left.
    """
    keys = list(fits)
    raw = np.array([fits[k].beta for k in keys])
    precise = np.linalg.inv(np.array([fits[k].covariance for k in keys]))
    pulled = np.einsum("kij,kj->ki", precise, raw)
    fixed = centre is not None
    middle = np.asarray(centre, float) if fixed else raw.mean(axis=0)
    spread = _positive(np.einsum("ki,kj->ij", raw - middle, raw - middle) / len(keys), 1e-4)
    floor = NO_SPREAD * np.mean([np.diag(f.covariance) for f in fits.values()], axis=0)
    ahead = Accelerated(spread)
    for _ in range(rounds):
        prior = np.linalg.inv(spread)
        covariances = np.linalg.inv(precise + prior)
        estimates = np.einsum("kij,kj->ki", covariances, pulled + prior @ middle)
        off = estimates - middle
        update = _positive((np.einsum("ki,kj->ij", off, off) + covariances.sum(axis=0)) / len(keys))
        last = middle
        middle = middle if fixed else estimates.mean(axis=0)
        moved = max(float(np.max(np.abs(update - spread))) / float(np.max(np.abs(spread))), float(np.max(np.abs(middle - last))))
        spread = _positive(ahead.next(update))
        if moved < tolerance or np.all(np.diag(update) < floor):
            moved, spread = 0.0, update
            break
    else:
        warnings.warn(f"the spread still moves by {moved:.2g} of its size: not converged", stacklevel=2)
    return Pooled(
        dict(zip(keys, estimates)), dict(zip(keys, covariances)), middle, spread, converged=moved < tolerance, fits=dict(fits)
    )


def joint_posterior(
    fits: dict[tuple, Fit], within: np.ndarray, between: np.ndarray, centre: np.ndarray | None
) -> tuple[dict[tuple, np.ndarray], dict[tuple, np.ndarray]]:
    """Estimates and covariances of (parent, child) strata at given spreads, all levels solved together.

    Unknowns are every parent, every child, and the centre where it is None.
    """
    p = len(within)
    parents = list(dict.fromkeys(k[0] for k in fits))
    n = len(parents) + len(fits) + (centre is None)
    precision, pull = np.zeros((n * p, n * p)), np.zeros(n * p)

    def tie(i: int, j: int, weight: np.ndarray) -> None:
        for a, b, sign in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
            precision[a * p : (a + 1) * p, b * p : (b + 1) * p] += sign * weight

    def hold(i: int, weight: np.ndarray, at: np.ndarray) -> None:
        precision[i * p : (i + 1) * p, i * p : (i + 1) * p] += weight
        pull[i * p : (i + 1) * p] += weight @ at

    for i in range(len(parents)):
        if centre is None:
            tie(i, n - 1, np.linalg.inv(between))
        else:
            hold(i, np.linalg.inv(between), np.asarray(centre, float))
    for j, (key, fit) in enumerate(fits.items(), len(parents)):
        tie(j, parents.index(key[0]), np.linalg.inv(within))
        hold(j, np.linalg.inv(fit.covariance), fit.beta)
    covariance = np.linalg.inv(precision)
    estimate = covariance @ pull
    at = {key: slice(j * p, (j + 1) * p) for j, key in enumerate(fits, len(parents))}
    return {k: estimate[x] for k, x in at.items()}, {k: covariance[x, x] for k, x in at.items()}


def pool_nested(fits: dict[tuple, Fit], centre: np.ndarray | None = None) -> Pooled:
    """Two-level pooling of (parent, child) strata: children to their parent, parents to the centre.

    The spreads are estimated level by level; at these, parents and children are solved jointly.
    """
    parents: dict = {}
    for key in fits:
        parents.setdefault(key[0], []).append(key)
    means = {}
    for parent, members in parents.items():
        precision = sum(np.linalg.inv(fits[k].covariance) for k in members)
        covariance = np.linalg.inv(precision)
        beta = covariance @ sum(np.linalg.solve(fits[k].covariance, fits[k].beta) for k in members)
        means[(parent,)] = replace(fits[members[0]], beta=beta, covariance=covariance)
    upper = pool(means, centre)
    offsets = {k: replace(f, beta=f.beta - upper.estimates[(k[0],)]) for k, f in fits.items()}
    lower = pool(offsets, np.zeros_like(next(iter(fits.values())).beta))
    estimates, covariances = joint_posterior(fits, lower.spread, upper.spread, centre)
    return Pooled(estimates, covariances, upper.centre, lower.spread, upper.spread, upper.converged and lower.converged, dict(fits))
