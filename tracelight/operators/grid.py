"""Prediction grids.

A grid is exploded from one row of ranges and level sets, so no cartesian join
is planned. A key with many values (rooms) stays a distributed column: its
distinct values are the rows that are exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions import even_grid
from tracelight.operators.prep import possible_cells


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def prediction_grid(
    frame: DataFrame,
    even: dict[str, int],
    levels: Sequence[str] = (),
    entity: str | None = None,
    drop_impossible: bool = True,
) -> DataFrame:
    """All combinations of even ranges, observed levels and (optionally) entities.

    ``even`` maps numeric columns to a number of points; ``levels`` are columns of
    few values (factor levels), gathered into sets.
    """
    parts = {}
    for column, points in even.items():
        low, high = F.min(column).cast("double"), F.max(column).cast("double")
        parts[column] = even_grid(low, high, points)
    for column in levels:
        parts[column] = F.sort_array(F.collect_set(column))
    axes = frame.agg(F.struct(*[c.alias(n) for n, c in parts.items()]).alias("axes"))
    if entity is None:
        grid = axes
        kept: list[str] = []
    else:
        grid = distinct_values(frame, entity).withColumn("axes", axes.scalar())
        kept = [entity]
    for name in parts:
        grid = grid.select("axes", *kept, F.explode(F.col(f"axes.{name}")).alias(name))
        kept.append(name)
    grid = grid.drop("axes")
    if drop_impossible and {"high_touch", "site_category"} <= set(grid.columns):
        grid = possible_cells(grid)
    return grid
