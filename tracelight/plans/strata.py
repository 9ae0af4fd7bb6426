"""Draws, predictions and scores of models whose strata are pooled.

A pooled stratum is a fit of its own (its coefficients, residual scale and hurdle
share), so its draws are tables of their own that carry the stratum's columns.
Strata are few: each costs one small table of draws.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions import is_detected
from tracelight.operators.grid import prediction_grid
from tracelight.operators.groups import undo_standard_score
from tracelight.operators.intervals import RIBBON
from tracelight.operators.prep import analysis_table
from tracelight.operators.reshape import stack
from tracelight.plans import catalog
from tracelight.plans.checks import compare_models, leave_one_out
from tracelight.plans.draws import expected_draws, expected_quantiles, laplace_draws
from tracelight.plans.fits import Fit
from tracelight.plans.mixture import Mixture, mixture_draws
from tracelight.plans.pooling import Pooled
from tracelight.session import cut_lineage


def strata_draws(spark: SparkSession, pooled: Pooled, keys: Sequence[str], count: int) -> DataFrame:
    """Draws of every stratum: its key columns, ``draw``, ``b<i>`` (and ``sigma``, ``hu``).

    Where the spread is integrated out, draws of all strata are joint draws of the mixture.
    """
    if isinstance(pooled, Mixture):
        return cut_lineage(mixture_draws(spark, pooled, list(keys), count))
    parts = []
    for key in sorted(pooled.estimates, key=str):
        wide = laplace_draws(spark, pooled.stratum(key), count)
        parts.append(wide.select(*[F.lit(v).alias(k) for k, v in zip(keys, key)], *wide.columns))
    return reduce(DataFrame.unionByName, parts)


def _cells(name: str, swabs: DataFrame, count: int, points: int) -> tuple[DataFrame, DataFrame]:
    """Grid of a pooled model over its axis and fitted strata, and the draws of these."""
    model = catalog.MODELS[name]
    table = catalog.model_table(name, swabs)
    pooled = catalog.fit_table(name, table)
    axis = model.design.columns[0]
    cells = prediction_grid(table.dropna(subset=[axis, *model.strata]), {axis: points}, model.strata)
    fitted = reduce(lambda a, b: a | b, [_is(model.strata, key) for key in pooled.estimates])
    return cells.where(fitted), strata_draws(swabs.sparkSession, pooled, model.strata, count)


def _unscaled(out: DataFrame, name: str, swabs: DataFrame) -> DataFrame:
    model = catalog.MODELS[name]
    if model.scaled is None:
        return out
    return undo_standard_score(out, model.design.columns[0], analysis_table(swabs, model.variant), model.scaled)


def strata_expected(name: str, swabs: DataFrame, count: int, points: int = 100) -> DataFrame:
    """Expected outcome of a pooled model by stratum, grid point and draw.

    A scaled axis is moved back to its own units.
    """
    model = catalog.MODELS[name]
    cells, wide = _cells(name, swabs, count, points)
    return _unscaled(expected_draws(cells, wide, model.design, count, model.family, model.strata), name, swabs)


def strata_ribbon(name: str, swabs: DataFrame, count: int, points: int = 100) -> DataFrame:
    """Median and equal-tail intervals of a pooled model by stratum and grid point."""
    model = catalog.MODELS[name]
    cells, wide = _cells(name, swabs, count, points)
    found = expected_quantiles(
        cells, wide, model.design, count, [model.design.columns[0], *model.strata], RIBBON, model.family, model.strata
    )
    return _unscaled(found, name, swabs)


def _is(keys: Sequence[str], key: tuple):
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(keys, key)])


def model_scores(name: str, fit: Fit | Pooled, counts: DataFrame, columns: Sequence[str], draws: int, smooth: bool) -> DataFrame:
    """Leave-one-out scores of the rows ``counts`` (columns, y, n) under one model of the catalogue."""
    model, spark = catalog.MODELS[name], counts.sparkSession
    if isinstance(fit, Fit):
        return leave_one_out(counts, columns, laplace_draws(spark, fit, draws), model.design, smooth, model.family)
    wide = strata_draws(spark, fit, model.strata, draws)
    parts = [
        leave_one_out(counts.where(_is(model.strata, key)), columns, wide.where(_is(model.strata, key)).drop(*model.strata), model.design, smooth, model.family)
        for key in sorted(fit.estimates, key=str)
    ]
    return reduce(DataFrame.unionByName, parts)


def compare_catalogue(
    names: Sequence[str], swabs: DataFrame, subjects: DataFrame | None, draws: int, smooth: bool = True
) -> DataFrame:
    """One comparison of the catalogue, on the rows of its first model's table that every model can score.

    Every model is fitted to that table, so all score the same rows with the same weights. The
    few columns they use are written once: each fit and each scoring would join the table anew.
    """
    models = [catalog.MODELS[n] for n in names]
    table = catalog.model_table(names[0], swabs, subjects)
    columns = list(dict.fromkeys(c for m in models for c in (*m.design.columns, *m.strata)))
    rows = table.dropna(subset=columns)
    if models[0].family == "bernoulli":
        rows = rows.dropna(subset=["scv2_detected"])
        y = F.col("scv2_detected").cast("int")
    else:
        y = F.when(is_detected(F.col("copies_max")), F.col("copies_max")).otherwise(0.0)
    rows = cut_lineage(rows.select(*columns, *[c for c in ("scv2_detected", "copies_max") if c not in columns]))
    counts = cut_lineage(rows.groupBy(y.alias("y"), *columns).agg(F.count(F.lit(1)).alias("n")))
    scores = {n: model_scores(n, catalog.fit_table(n, rows), counts, columns, draws, smooth) for n in names}
    return compare_models(stack(scores), ["y", *columns])
