"""Approximate posterior draws as tables and expected predictions from them.

Draws come from the normal approximation at the mode. They are not a sampler's
output: ``importance_weights`` scores how far the approximation is off, and the
effective sample size it reports should be close to the number of draws.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelight.functions import normal_score
from tracelight.operators.joins import keyed_join
from tracelight.plans.design import Design
from tracelight.plans.fits import PRIOR_SD, Fit
from tracelight.schemas import DRAWS
from tracelight.session import cut_lineage

CHAINS = 4


def half_covariance(fit: Fit) -> np.ndarray:
    """Upper triangular ``C`` with ``C C'`` equal to the covariance."""
    precision = np.linalg.inv(fit.covariance)
    return np.linalg.inv(np.linalg.cholesky((precision + precision.T) / 2)).T


def laplace_draws(spark: SparkSession, fit: Fit, count: int) -> DataFrame:
    """``draw`` and one column ``b<i>`` per parameter (``sigma`` and ``hu`` if the model has them).

    The table is written once: it is small, used many times, and filters on
    predictions would otherwise be pushed down through the long score expressions.
    """
    p = len(fit.beta)
    scores = spark.range(count).withColumnRenamed("id", "draw")
    extra = (fit.sigma is not None) + (fit.hurdle is not None)
    scores = scores.select("draw", *[normal_score(F.col("draw"), j).alias(f"z{j}") for j in range(p + extra)])
    half = half_covariance(fit)
    columns = []
    for i in range(p):
        value = F.lit(float(fit.beta[i]))
        for j in range(i, p):
            value = value + F.lit(float(half[i, j])) * F.col(f"z{j}")
        columns.append(value.alias(f"b{i}"))
    if fit.sigma is not None:
        share = fit.hurdle or 0.0
        used = max(fit.rows * (1.0 - share) - p, 1.0)
        columns.append((F.lit(fit.sigma) * F.exp(F.col(f"z{p}") / np.sqrt(2.0 * used))).alias("sigma"))
    if fit.hurdle is not None:
        share = min(max(fit.hurdle, 0.5 / fit.rows), 1 - 0.5 / fit.rows)
        odds, error = np.log(share / (1 - share)), 1 / np.sqrt(fit.rows * share * (1 - share))
        logit = F.lit(float(odds)) + F.lit(float(error)) * F.col(f"z{p + 1}")
        columns.append((1.0 / (1.0 + F.exp(-logit))).alias("hu"))
    return cut_lineage(scores.select("draw", *columns))


def long_draws(wide: DataFrame, design: Design, model_name: str, chains: int = CHAINS) -> DataFrame:
    """Long draws table: one row per draw and parameter."""
    names = {f"b{i}": p for i, p in enumerate(design.parameters)}
    renamed = wide.withColumnsRenamed(names)
    values = [c for c in renamed.columns if c != "draw"]
    return renamed.unpivot(["draw"], values, "param", "value").select(
        F.lit(model_name).alias("model_name"),
        (F.col("draw") % chains).cast("int").alias("chain"),
        F.floor(F.col("draw") / chains).alias("iteration"),
        "draw", "param", "value",
    ).select(*DRAWS.fieldNames())


def wide_draws(draws: DataFrame, design: Design) -> DataFrame:
    """Back from long to one row per draw with columns ``b<i>``, ``sigma``, ``hu``."""
    names = {p: f"b{i}" for i, p in enumerate(design.parameters)} | {"sigma": "sigma", "hu": "hu"}
    picked = [F.max(F.when(F.col("param") == p, F.col("value"))).alias(c) for p, c in names.items()]
    return draws.groupBy("draw").agg(*picked)


def thin(draws: DataFrame, count: int) -> DataFrame:
    """The first ``count`` draws; low-discrepancy draws have no warm-up to skip."""
    return draws.where(F.col("draw") < count)


def draw_matrix(draws: DataFrame, p: int, extra: Sequence[str] = ()) -> np.ndarray:
    """Draws as a (draws x parameters) matrix; its size is the number of draws the caller asked for."""
    names = [*[f"b{i}" for i in range(p)], *extra]
    rows = draws.select("draw", *names).orderBy("draw").collect()
    return np.array([[row[name] for name in names] for row in rows])


def pair_with_draws(grid: DataFrame, draws: DataFrame, count: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every grid row with each of its draws, as an equi-join on the draw number.

    Both sides are bounded by parameters (grid points, draws); the grid is spread
    over tasks before it is multiplied.
    """
    tasks = grid.sparkSession.sparkContext.defaultParallelism
    numbered = grid.repartition(tasks, *grid.columns).withColumn(
        "draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    )
    return keyed_join(numbered, thin(draws, count), [*keys, "draw"], "inner")


@dataclass(frozen=True)
class DrawTable:
    """Draws as one matrix (or one for each key), of a size the caller asked for; tasks hold it whole."""

    keys: tuple[str, ...]
    values: dict[tuple, np.ndarray]
    family: str

    @classmethod
    def of(cls, draws: DataFrame, p: int, count: int, family: str, keys: Sequence[str] = ()) -> DrawTable:
        extra = ["sigma", "hu"] if family == "hurdle_lognormal" else []
        names = [f"b{i}" for i in range(p)] + extra
        found = thin(draws, count).select(*keys, "draw", *names).toPandas().sort_values("draw")
        groups = found.groupby(list(keys), dropna=False) if keys else [((), found)]
        return cls(tuple(keys), {k: g[names].to_numpy(float) for k, g in groups}, family)

    def expected(self, key: tuple, x: np.ndarray) -> np.ndarray:
        """Expected outcome (rows x draws) of design rows."""
        table = self.values.get(key)
        if table is None:
            return np.zeros((len(x), 0))
        eta = np.zeros((len(x), len(table)))
        for i in range(x.shape[1]):  # term by term, in the order of the linear predictor
            eta += x[:, i, None] * table[:, i]
        if self.family == "bernoulli":
            return 1.0 / (1.0 + np.exp(-eta))
        if self.family == "hurdle_lognormal":
            sigma, hu = table[:, -2], table[:, -1]
            return (1.0 - hu) * np.exp(eta + sigma * sigma / 2.0)
        return eta


def _designed(grid: DataFrame, design: Design) -> DataFrame:
    """``grid`` as struct ``point`` with its design row ``x``, spread over the tasks; a grid is small by construction."""
    x = F.array(*[c.cast("double") for c in design.expressions().values()])
    return grid.select(F.struct(*grid.columns).alias("point"), x.alias("x"))


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def expected_draws(
    grid: DataFrame, draws: DataFrame, design: Design, count: int, family: str = "bernoulli",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Expected outcome per grid row and draw, as grid columns, ``draw``, ``epred``.

    Tasks hold the draws and multiply their grid rows with them: no join, no shuffle of grid times draws.
    """
    p = len(design.parameters)
    table = DrawTable.of(draws, p, count, family, keys)
    tasks = grid.sparkSession.sparkContext.defaultParallelism
    points = _designed(grid, design).repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point, x = batch.column("point"), _matrix(batch.column("x"), p)
            for row in range(batch.num_rows):
                found = table.expected(tuple(point.field(k)[row].as_py() for k in table.keys), x[row : row + 1])[0]
                repeated = point.take(pa.array(np.full(len(found), row)))
                yield pa.RecordBatch.from_arrays([repeated, pa.array(np.arange(len(found))), pa.array(found)], names=["point", "draw", "epred"])

    schema = StructType([points.schema["point"]]).add("draw", "long").add("epred", "double")
    return points.mapInArrow(run, schema).select("point.*", "draw", "epred")


def expected_quantiles(
    grid: DataFrame, draws: DataFrame, design: Design, count: int, groups: Sequence[str], points: dict[str, float],
    family: str = "bernoulli", keys: Sequence[str] = (),
) -> DataFrame:
    """Quantiles (name: share) of the expected outcome over all draws and grid rows of a group.

    The grid rows of a group come together in one row (a grid is small by construction); their values
    with all draws are made and reduced in place, so neither of them is a row anywhere. ``keys`` are
    among ``groups``.
    """
    p = len(design.parameters)
    table = DrawTable.of(draws, p, count, family, keys)
    x = F.array(*[c.cast("double") for c in design.expressions().values()])
    rows = grid.groupBy(*groups).agg(F.collect_list(x).alias("x")).select(F.struct(*groups).alias("point"), "x")
    shares = list(points.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point, out = batch.column("point"), []
            for row in range(batch.num_rows):
                design_rows = np.array(batch.column("x")[row].as_py(), float).reshape(-1, p)
                values = table.expected(tuple(point.field(k)[row].as_py() for k in table.keys), design_rows)
                out.append(np.quantile(values, shares) if values.size else np.full(len(shares), np.nan))
            columns = np.array(out).reshape(-1, len(shares)).T
            yield pa.RecordBatch.from_arrays([point, *[pa.array(c.copy(), from_pandas=True) for c in columns]], names=["point", *points])

    schema = StructType([rows.schema["point"]])
    for name in points:
        schema = schema.add(name, "double")
    return rows.mapInArrow(run, schema).select("point.*", *points)


def importance_weights(
    patterns: DataFrame, draws: DataFrame, fit: Fit, prior_sd: float | None = PRIOR_SD
) -> tuple[DataFrame, float]:
    """Normalised weight of every draw and the effective sample size.

    The log likelihood of all draws is one matrix product per batch of patterns;
    each batch yields one partial sum per draw.
    """
    p = len(fit.beta)
    matrix = draw_matrix(draws, p)
    spark = patterns.sparkSession

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(matrix))
        for batch in batches:
            x = batch[[f"x{i}" for i in range(p)]].to_numpy(float)
            n, k = batch["n"].to_numpy(float), batch["k"].to_numpy(float)
            eta = x @ matrix.T
            total += k @ eta - n @ np.logaddexp(0.0, eta)
        yield pd.DataFrame({"draw": np.arange(len(matrix), dtype="int64"), "loglik": total})

    sums = patterns.mapInPandas(partial_sums, "draw bigint, loglik double")
    sums = sums.groupBy("draw").agg(F.sum("loglik").alias("loglik"))
    moved = matrix - fit.beta
    precision = np.linalg.inv(fit.covariance)
    log_q = -0.5 * np.einsum("si,ij,sj->s", moved, precision, moved)
    log_prior = np.zeros(len(matrix)) if prior_sd is None else -0.5 * (matrix**2).sum(axis=1) / prior_sd**2
    offsets = spark.createDataFrame(
        [(i, float(a)) for i, a in enumerate(log_prior - log_q)], "draw bigint, offset double"
    )
    scored = keyed_join(sums, offsets, ["draw"]).select("draw", (F.col("loglik") + F.col("offset")).alias("logw"))
    top = scored.agg(F.max("logw")).scalar()
    raw = scored.withColumn("_raw", F.exp(F.col("logw") - top))
    weighted = raw.withColumn("weight", F.col("_raw") / raw.agg(F.sum("_raw")).scalar()).select("draw", "weight")
    rows = weighted.collect()
    weights = np.array([r["weight"] for r in rows])
    size = float(1.0 / (weights**2).sum())
    if size < 0.5 * len(weights):
        warnings.warn(f"effective sample size {size:.0f} of {len(weights)}: the approximation is poor", stacklevel=2)
    return weighted, size


def resample(draws: DataFrame, weights: DataFrame, count: int) -> DataFrame:
    """Systematic resampling by cumulative weight, so later steps need no weights."""
    running = Window.orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = weights.select("draw", F.sum("weight").over(running).alias("_upper"), "weight")
    first = F.ceil((F.col("_upper") - F.col("weight")) * count - 0.5)
    last = F.ceil(F.col("_upper") * count - 0.5) - 1
    chosen = edges.where(last >= first).select("draw", F.explode(F.sequence(first, last)).alias("_new"))
    joined = keyed_join(chosen, draws, ["draw"], "inner").drop("draw")
    return joined.where(F.col("_new").between(0, count - 1)).withColumnRenamed("_new", "draw")


def parameter_summary(draws: DataFrame) -> DataFrame:
    """Estimate, error and 95 % limits per model and parameter."""
    limits = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    grouped = draws.groupBy("model_name", "param").agg(
        F.avg("value").alias("Estimate"), F.stddev_samp("value").alias("Est_Error"), limits.alias("_q")
    )
    return grouped.select(
        "model_name", "param", "Estimate", "Est_Error",
        F.col("_q")[0].alias("Q2_5"), F.col("_q")[1].alias("Q97_5"),
    )


def with_odds(summary: DataFrame) -> DataFrame:
    """Exponentiated copies of all numeric columns, suffix ``_exp``."""
    from tracelight.operators.prep import map_numeric

    return map_numeric(summary, F.exp, "exp")


def lookup_parameter(summary: DataFrame, model_name: str, pattern: str) -> DataFrame:
    """Rows of one model whose parameter name matches a regular expression."""
    return summary.where((F.col("model_name") == model_name) & F.col("param").rlike(pattern))
