"""Pooling of a few strata with the spread integrated out.

Two or three strata say little about the spread between them, so limits at one estimate of
it are too narrow. Here the spread has its prior (half-t standard deviations, uniform
correlations) and is integrated numerically: every node is one spread with a weight, the
product of prior and marginal likelihood, and given the spread the strata are normal. Up
to three unknowns of the spreads take a product rule; more take a low-discrepancy set.
Draws pick a node by its weight and then the strata jointly, so all limits are those of
the mixture. Sizes are those of the strata and nodes, whatever the number of rows was.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tracelight.functions.normal import inverse_normal_array, primes
from tracelight.plans.fits import Fit
from tracelight.plans.pooling import Pooled

#: Degrees of freedom and scale of the prior of a standard deviation between strata.
PRIOR = (3.0, 2.5)
#: Nodes of a product rule for a standard deviation and for a correlation; nodes of a low-discrepancy set.
SD_NODES, COR_NODES, SET_NODES = 40, 16, 20_000
#: Standard deviation of a centre that is not given, around the strata's mean: as good as none.
WIDE = 100.0


@dataclass
class Mixture(Pooled):
    """``Pooled`` by moments of the mixture; ``weights`` and ``nodes`` are those of the spreads, (node, level, p, p)."""

    weights: np.ndarray | None = None
    nodes: np.ndarray | None = None
    joint_mean: np.ndarray | None = None
    joint_cover: np.ndarray | None = None


def _unknowns(p: int) -> int:
    return p + p * (p - 1) // 2


def _spreads(x: np.ndarray, p: int, prior: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(spread, log prior density of ``x``) for points of the unit cube: ``p`` standard deviations, then partial correlations."""
    df, scale = prior
    part = x[:, :p]
    # Dense near zero, where strata that hardly differ need it.
    odds = part / (1 - part)
    sd = scale * odds**2
    logp = -0.5 * (df + 1) * np.log1p((sd / scale) ** 2 / df)
    logp = (logp + np.log(2 * odds) - 2 * np.log1p(-part)).sum(axis=1)
    lower = np.zeros((len(x), p, p))
    lower[:, 0, 0] = 1
    at = p
    for i in range(1, p):
        left = np.ones(len(x))
        for j in range(i):
            # Uniform over correlation matrices: a partial correlation after j others is a symmetric beta.
            r = 2 * x[:, at] - 1
            logp += 0.5 * (p - 2 - j) * np.log1p(-(r**2))
            lower[:, i, j] = r * np.sqrt(left)
            left = left - lower[:, i, j] ** 2
            at += 1
        lower[:, i, i] = np.sqrt(np.maximum(left, 0))
    half = sd[:, :, None] * lower
    return half @ half.transpose(0, 2, 1), logp


def _roots(spreads: np.ndarray) -> np.ndarray:
    """``R`` with ``R R'`` equal to each spread; a spread may be singular, or of any size."""
    sd = np.sqrt(np.maximum(np.diagonal(spreads, axis1=1, axis2=2), 1e-300))
    values, axes = np.linalg.eigh(spreads / sd[:, :, None] / sd[:, None, :])
    return sd[:, :, None] * axes * np.sqrt(np.maximum(values, 0))[:, None, :]


def spread_nodes(p: int, levels: int, prior: tuple[float, float] = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """(spreads by node and level, log weights without the likelihood)."""
    each = _unknowns(p)
    if each * levels <= 3:
        rules = []
        for k in range(each * levels):
            t, w = np.polynomial.legendre.leggauss(SD_NODES if k % each < p else COR_NODES)
            rules.append(((t + 1) / 2, np.log(w / 2)))
        x = np.stack(np.meshgrid(*[t for t, _ in rules], indexing="ij"), axis=-1).reshape(-1, len(rules))
        weight = np.stack(np.meshgrid(*[w for _, w in rules], indexing="ij"), axis=-1).reshape(-1, len(rules)).sum(axis=1)
    else:
        roots = np.sqrt(np.array(primes(each * levels), float))
        x = np.clip((np.arange(1, SET_NODES + 1)[:, None] * roots) % 1.0, 1e-6, 0.997)
        weight = np.full(SET_NODES, -np.log(SET_NODES))
    parts = [_spreads(x[:, k * each : (k + 1) * each], p, prior) for k in range(levels)]
    return np.stack([s for s, _ in parts], axis=1), weight + sum(w for _, w in parts)


def integrate(fits: dict[tuple, Fit], centre: np.ndarray | None = None, prior: tuple[float, float] = PRIOR) -> Mixture:
    """Strata (one key) or children of parents (two) shrunk to ``centre``, or to their common mean if None."""
    keys = list(fits)
    raw = np.array([fits[k].beta for k in keys])
    many, p = raw.shape
    levels = len(keys[0])
    spreads, logw = spread_nodes(p, levels, prior)
    middle = raw.mean(axis=0) if centre is None else np.asarray(centre, float)
    # Prior covariance of all strata together is F F': their own level, then that of the parent they share.
    parents = list(dict.fromkeys(k[0] for k in keys)) if levels == 2 else []
    shared = np.array([[k[0] == parent for parent in parents] for k in keys], float).reshape(many, len(parents))
    wide = np.zeros((many, 0)) if centre is not None else WIDE * np.ones((many, 1))
    # Everything in units of the strata's own errors: the covariance is C (1 + G G') C', G = C^-1 F.
    units = np.linalg.cholesky(np.array([fits[k].covariance for k in keys]))
    inverse = np.linalg.inv(units)
    blocks = [np.einsum("ab,aij,njk->naibk", np.eye(many), inverse, _roots(spreads[:, -1]))]
    if levels == 2:
        blocks.append(np.einsum("ab,aij,njk->naibk", shared, inverse, _roots(spreads[:, 0])))
    blocks = [x.reshape(len(spreads), many * p, -1) for x in blocks]
    if centre is None:
        far = np.einsum("ab,aij->aibj", wide, inverse).reshape(many * p, -1)
        blocks.append(np.broadcast_to(far, (len(spreads), *far.shape)))
    # Singular values keep both a spread of any size and errors far below it, where sums of the two would lose these.
    axes, size, _ = np.linalg.svd(np.concatenate(blocks, axis=2), full_matrices=False)
    left = np.einsum("aij,aj->ai", inverse, raw - middle).ravel()
    pulled = left @ axes
    logw = logw - 0.5 * (pulled**2 / (1 + size**2)).sum(axis=1) - 0.5 * np.log1p(size**2).sum(axis=1)
    weight = np.exp(logw - logw.max())
    weight /= weight.sum()
    some = weight > 1e-10
    weight, spreads, axes, size, pulled = weight[some] / weight[some].sum(), spreads[some], axes[some], size[some], pulled[some]
    if len(weight) == SET_NODES and 1 / (weight**2).sum() < 50:
        warnings.warn("few spreads carry the weight: the integral over them is rough", stacklevel=2)
    whole = np.einsum("aij,ab->aibj", units, np.eye(many)).reshape(many * p, many * p)
    axes, share = whole @ axes, size**2 / (1 + size**2)
    mean = np.tile(middle, many) + (axes @ (share * pulled)[:, :, None])[:, :, 0]
    given = (axes * share[:, None, :]) @ axes.transpose(0, 2, 1)
    average = weight @ mean
    total = np.einsum("n,nij->ij", weight, given) + np.einsum("n,ni,nj->ij", weight, mean - average, mean - average)
    at = {k: slice(i * p, (i + 1) * p) for i, k in enumerate(keys)}
    mean_spread = np.einsum("n,nlij->lij", weight, spreads)
    return Mixture(
        {k: average[x] for k, x in at.items()}, {k: total[x, x] for k, x in at.items()}, middle, mean_spread[-1],
        mean_spread[0] if levels == 2 else None, True, dict(fits), weight, spreads, mean, given,
    )


def mixture_draws(spark: SparkSession, mixed: Mixture, keys: list[str], count: int) -> DataFrame:
    """Joint draws of all strata: their key columns, ``draw``, ``b<i>`` (and ``sigma``, ``hu``); as many rows as draws times strata."""
    strata, d = list(mixed.estimates), mixed.joint_mean.shape[1]
    p = d // len(strata)
    roots = np.sqrt(np.array(primes(d + 3), float))
    uniform = np.clip((np.arange(1, count + 1)[:, None] * roots) % 1.0, 1e-9, 1 - 1e-9)
    node = np.minimum(np.searchsorted(np.cumsum(mixed.weights), uniform[:, 0]), len(mixed.weights) - 1)
    used, where = np.unique(node, return_inverse=True)
    half = np.linalg.cholesky(mixed.joint_cover[used] + 1e-12 * np.eye(d) * np.trace(mixed.joint_cover[used], axis1=1, axis2=2)[:, None, None] / d)
    z = inverse_normal_array(uniform[:, 1:])
    values = mixed.joint_mean[node] + (half[where] @ z[:, :d, None])[:, :, 0]
    parts = []
    for i, key in enumerate(strata):
        fit = mixed.fits[key]
        columns = dict(zip(keys, key, strict=True)) | {"draw": np.arange(count)} | {f"b{j}": values[:, i * p + j] for j in range(p)}
        if fit.sigma is not None:
            used_rows = max(fit.rows * (1.0 - (fit.hurdle or 0.0)) - p, 1.0)
            columns["sigma"] = fit.sigma * np.exp(z[:, d] / np.sqrt(2.0 * used_rows))
        if fit.hurdle is not None:
            share = min(max(fit.hurdle, 0.5 / fit.rows), 1 - 0.5 / fit.rows)
            columns["hu"] = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + z[:, d + 1] / np.sqrt(fit.rows * share * (1 - share)))))
        parts.append(pd.DataFrame(columns))
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))
