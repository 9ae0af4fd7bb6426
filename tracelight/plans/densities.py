"""Observed outcomes against simulated ones, as densities on a fixed grid.

Values are shared between the two grid points around them (linear binning), which is one
map-side aggregate for any number of rows; the kernel then runs over the grid points only.
Simulations take their randomness from the row's key and the draw's number, so a retried
task repeats them. A few draws are sent to every task; draws of many rooms are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.functions import inverse_normal
from tracelight.functions.normal import primes
from tracelight.operators.joins import LOOKUP_ROWS, keyed_join, with_group_stats
from tracelight.plans.design import Design, linear_predictor
from tracelight.session import cut_lineage

#: Row keys count modulo this, so that their multiples keep enough digits.
PERIOD = 1 << 26
OBSERVED = -1
#: Share of a group's range that the grid of its density is wider on either side.
MARGIN = 0.1


def row_uniform(key: Column, draw: Column, salt: int) -> Column:
    """A number strictly inside (0, 1) for a row and a draw: a low-discrepancy sequence in both."""
    first, second = (float(np.sqrt(p)) for p in primes(2 * salt + 2)[-2:])
    x = (F.pmod(key, F.lit(PERIOD)) + 1).cast("double") * F.lit(first) + (draw + 1).cast("double") * F.lit(second)
    return F.least(F.greatest(x - F.floor(x), F.lit(1e-9)), F.lit(1 - 1e-9))


def with_draws(rows: DataFrame, draws: DataFrame, count: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every row with each of the first ``count`` draws (of its ``keys``)."""
    few = cut_lineage(draws.where(F.col("draw") < count))
    numbered = rows.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))))
    # A lookup of a counted size is sent; nothing of ``rows`` is then shuffled.
    return keyed_join(numbered, F.broadcast(few) if few.count() <= LOOKUP_ROWS else few, [*keys, "draw"], "inner")


def simulated(paired: DataFrame, design: Design, key: str, family: str) -> DataFrame:
    """(draw, x): a simulated outcome for each row and draw; log10 quantities, or 0 and 1. Undetected ones are left out."""
    mu = linear_predictor([F.col(f"b{i}") for i in range(len(design.parameters))], design)
    u, v = (row_uniform(F.col(key), F.col("draw"), salt) for salt in (0, 1))
    if family == "bernoulli":
        return paired.select("draw", (u < 1.0 / (1.0 + F.exp(-mu))).cast("double").alias("x"))
    if family != "gaussian":
        paired = paired.where(u >= F.col("hu"))
    # ``v`` is a column of its own: the quantile names it some forty times, and written out each time it is too long to be compiled.
    placed = paired.select("draw", mu.alias("mu"), "sigma", v.alias("v"))
    x = F.col("mu") + F.col("sigma") * inverse_normal(F.col("v"))
    return placed.select("draw", (x if family == "gaussian" else x / F.lit(float(np.log(10.0)))).alias("x"))


def linear_bins(rows: DataFrame, keys: Sequence[str], low: float, high: float, points: int) -> DataFrame:
    """(keys, bin, weight): every value ``x`` shared between the two of ``points`` grid points around it, the outer ones take what lies beyond."""
    at = F.least(F.greatest((F.col("x") - low) / ((high - low) / (points - 1)), F.lit(0.0)), F.lit(float(points - 1)))
    placed = rows.select(*keys, F.when(F.col("x").isNotNull(), at).alias("at"))
    left = F.least(F.floor("at"), F.lit(points - 2))
    # Counts and shares of the left point first: only sums are dealt to both points.
    cells = placed.select(*keys, "at", left.alias("left")).groupBy(*keys, "left").agg(F.count("at").alias("n"), F.sum(F.col("at") - F.col("left")).alias("beyond"))
    both = F.array(
        F.struct(F.col("left").alias("bin"), (F.col("n") - F.col("beyond")).alias("weight")),
        F.struct((F.col("left") + 1).alias("bin"), F.col("beyond").alias("weight")),
    )
    return cells.where(F.col("n") > 0).select(*keys, F.inline(both)).groupBy(*keys, "bin").agg(F.sum("weight").alias("weight"))


def smoothed(binned: DataFrame, keys: Sequence[str], low: float, high: float, points: int) -> DataFrame:
    """(keys, bin, x, weight, density): normal kernel over the grid, as wide as 0.9 sd n^(-1/5) of the group, but no less than a step."""
    step = (high - low) / (points - 1)
    placed = binned.withColumn("x", F.lit(low) + F.col("bin") * F.lit(step))
    whole = placed.groupBy(*keys).agg(
        F.sum("weight").alias("n"), (F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("m"),
        (F.sum(F.col("weight") * F.col("x") * F.col("x")) / F.sum("weight")).alias("s"),
    )
    sd = F.sqrt(F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0)))
    wide = whole.select(*keys, "n", F.greatest(0.9 * sd * F.pow("n", F.lit(-0.2)), F.lit(step)).alias("h"))
    # At most ``points`` rows of a group meet ``points`` places.
    every = wide.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))))
    every = every.withColumn("at", F.lit(low) + F.col("bin") * F.lit(step))
    met = keyed_join(every, placed.select(*keys, "x", "weight", F.col("bin").alias("from")), keys, "inner")
    away = (F.col("at") - F.col("x")) / F.col("h")
    kernel = F.exp(-0.5 * away * away) / (F.col("h") * F.col("n") * F.lit(float(np.sqrt(2 * np.pi))))
    own = F.sum(F.when(F.col("from") == F.col("bin"), F.col("weight")).otherwise(0.0))
    return met.groupBy(*keys, "bin", F.col("at").alias("x")).agg(own.alias("weight"), F.sum(F.col("weight") * kernel).alias("density"))


def density_check(
    rows: DataFrame, draws: DataFrame, design: Design, key: str, family: str, edges: tuple[float, float, int],
    count: int = 10, keys: Sequence[str] = (),
) -> DataFrame:
    """Density of the observed outcome (draw -1) and of each simulated data set: draw, bin, x, weight, density.

    ``edges`` is (low, high, grid points). ``keys`` tell which draws belong to a row (strata, or rooms).
    """
    low, high, points = edges
    outcome = "scv2_detected" if family == "bernoulli" else "copies_max"
    used = rows.select(*dict.fromkeys([key, *keys, *design.columns]), outcome).dropna(subset=[key, *keys, *design.columns])
    if family == "gaussian":  # fitted to detected rows alone
        used = used.where(F.col(outcome) > 0)
    seen = F.col(outcome).cast("double") if family == "bernoulli" else F.when(F.col(outcome) > 0, F.log10(outcome))
    made = simulated(with_draws(used.drop(outcome), draws, count, keys), design, key, family)
    both = made.unionByName(used.select(F.lit(OBSERVED).cast("bigint").alias("draw"), seen.alias("x")))
    return smoothed(linear_bins(both, ["draw"], low, high, points), ["draw"], low, high, points)


def density_regions(
    df: DataFrame, keys: Sequence[str], value: str, mass: float = 0.95, points: int = 129
) -> DataFrame:
    """The regions of highest density that hold ``mass`` of each group: keys, ``region`` (from the lowest), lower, upper, share.

    Several modes may give several intervals. The density is that of ``smoothed`` over a grid a little
    wider than the group's range; grid points are taken from the densest down until they hold ``mass``
    of the values, neighbours form one interval, and its ends lie where the density, linear between grid
    points, crosses that of the last point taken. ``share`` is the part of the values that an interval holds.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = with_group_stats(rows, keys, {"_low": F.min("_v"), "_high": F.max("_v")})
    wide = (F.col("_high") - F.col("_low")) * (1 + 2 * MARGIN)
    start = F.col("_low") - (F.col("_high") - F.col("_low")) * MARGIN
    scaled = rows.select(*keys, F.when(wide > 0, (F.col("_v") - start) / wide).otherwise(0.5).alias("x"))
    dense = smoothed(linear_bins(scaled, keys, 0.0, 1.0, points), keys, 0.0, 1.0, points)
    group = Window.partitionBy(*keys)
    # Relative to the highest, and rounded: equal heights stay equal.
    dense = dense.withColumn("density", F.round(F.col("density") / F.max("density").over(group), 12))
    down = group.orderBy(F.desc("density"), "bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The kernel says which places come first, the values how many of them it takes; a hair of rounding decides nothing.
    dense = dense.withColumn("_before", F.sum("weight").over(down) - F.col("weight")).withColumn("_all", F.sum("weight").over(group))
    taken = F.col("_before") < F.col("_all") * F.lit(mass - 1e-9)
    dense = dense.withColumn("_cut", F.min(F.when(taken, F.col("density"))).over(group))
    line = group.orderBy("bin")
    dense = dense.withColumn("_left", F.lag("density").over(line)).withColumn("_right", F.lead("density").over(line))
    kept = dense.where(F.col("density") >= F.col("_cut")).withColumn("_run", F.col("bin") - F.row_number().over(line))
    step, over = F.lit(1.0 / (points - 1)), F.col("density") - F.col("_cut")
    lower = F.when(F.col("_left") < F.col("_cut"), F.col("x") - step * over / (F.col("density") - F.col("_left"))).otherwise(F.col("x"))
    upper = F.when(F.col("_right") < F.col("_cut"), F.col("x") + step * over / (F.col("density") - F.col("_right"))).otherwise(F.col("x"))
    runs = kept.groupBy(*keys, "_run").agg(
        F.min(lower).alias("lower"), F.max(upper).alias("upper"), (F.sum("weight") / F.first("_all")).alias("share"))
    ends = df.groupBy(*keys).agg(F.min(F.col(value).cast("double")).alias("_low"), F.max(F.col(value).cast("double")).alias("_high"))
    placed = keyed_join(runs, ends, keys)
    back = lambda c: (start + F.col(c) * wide).alias(c)
    region = F.row_number().over(group.orderBy("_run")).alias("region")
    return placed.select(*keys, region, back("lower"), back("upper"), "share")
