"""Intervals of draws: ribbons, shortest intervals and median curves.

A ribbon or curve group is bounded by its construction: the draws of one grid
point, times the pooled grid points. Shortest intervals take groups of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.operators.groups import range_ranks
from tracelight.operators.joins import keyed_join

# Equal-tail 95, 80 and 50 % intervals around the median.
RIBBON = {
    "lower95": 0.025, "lower80": 0.1, "lower50": 0.25, "median": 0.5,
    "upper50": 0.75, "upper80": 0.9, "upper95": 0.975,
}


def ribbon(epred: DataFrame, keys: Sequence[str], value: str = "epred") -> DataFrame:
    """Median and equal-tail intervals per key, pooling all other dimensions."""
    points = F.percentile(value, F.array(*[F.lit(p) for p in RIBBON.values()]))
    grouped = epred.groupBy(*keys).agg(points.alias("_q"))
    return grouped.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(RIBBON)])


def median_curve(epred: DataFrame, keys: Sequence[str], value: str = "epred") -> DataFrame:
    return epred.groupBy(*keys).agg(F.median(value).alias(value))


def shortest_interval(
    epred: DataFrame, keys: Sequence[str], value: str = "epred", mass: float = 0.95, tie: Sequence[str] = ()
) -> DataFrame:
    """Median and the single shortest interval holding ``mass`` of the draws.

    Candidates are runs of ``ceil(mass * n)`` sorted draws; the lowest wins a tie.
    ``tie`` names columns that tell rows of equal value apart, for data in which
    one value may be very frequent.
    """
    keys = list(keys)
    rows = epred.select(*keys, *tie, F.col(value).alias("_x")).where(F.col("_x").isNotNull())
    ranked = range_ranks(rows, keys, "_x", tie)
    # Rounded before the ceiling: 0.95 * 100 is a hair above 95 in binary.
    span = F.ceil(F.round(F.col("_n") * F.lit(mass), 9)) - 1
    upper = ranked.select(*keys, (F.col("_rank") - span).alias("_rank"), F.col("_x").alias("_upper"))
    pairs = keyed_join(ranked, upper.where(F.col("_rank") > 0), [*keys, "_rank"])
    best = F.min(F.when(F.col("_upper").isNotNull(), F.struct(
        (F.col("_upper") - F.col("_x")).alias("width"), F.col("_x"), F.col("_upper"))))
    middle = F.col("_rank").between(F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2))
    return (
        pairs.groupBy(*keys).agg(F.avg(F.when(middle, F.col("_x"))).alias(value), best.alias("_best"))
        .select(*keys, value, F.col("_best._x").alias("lower"), F.col("_best._upper").alias("upper"))
    )
