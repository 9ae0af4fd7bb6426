"""Exact interpolated quantiles of groups of any size.

``percentile`` buffers every distinct value of a group in one task. That suits
groups of a measured or constructed bound and nothing else. For larger groups
each group is cut at a few sketched split points around the wanted ranks, the
chunks are counted map-side, and only the narrow chunks that hold a wanted rank
are sorted. The sketch decides how narrow these are, never which value is
returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.operators.joins import keyed_join

SKETCH_ACCURACY = 10_000
MARGIN = 3.0 / SKETCH_ACCURACY
BUFFERED_ROWS = 1_000_000


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    buffered_rows: int = BUFFERED_ROWS,
) -> DataFrame:
    """One row per group: keys and one column per named quantile.

    Linear interpolation between order statistics; null and NaN values are
    skipped and a group without values is absent. The largest group is measured
    first: up to ``buffered_rows`` the plain aggregate is used, beyond it the
    chunked plan.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_x"))
    rows = rows.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    if largest <= buffered_rows:
        return buffered_quantiles(rows, keys, "_x", quantiles)
    return chunked_quantiles(rows, keys, quantiles)


def buffered_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Quantiles of groups that fit in a task's memory."""
    points = F.percentile(value, F.array(*[F.lit(float(p)) for p in quantiles.values()]))
    grouped = df.groupBy(*keys).agg(points.alias("_q"))
    return grouped.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(quantiles)])


def chunked_quantiles(
    rows: DataFrame, keys: Sequence[str], quantiles: dict[str, float], margin: float = MARGIN
) -> DataFrame:
    """Quantiles of the non-missing ``_x`` column of ``rows`` for groups of any size."""
    keys = list(keys)
    cuts = sorted({min(max(p + d, 0.0), 1.0) for p in quantiles.values() for d in (-margin, margin)})
    splits = rows.groupBy(*keys).agg(F.percentile_approx("_x", cuts, SKETCH_ACCURACY).alias("_splits"))
    chunk = reduce(
        lambda a, b: a + b, [(F.col("_splits")[i] < F.col("_x")).cast("int") for i in range(len(cuts))]
    )
    marked = keyed_join(rows, splits, keys).select(*keys, "_x", chunk.alias("_chunk"))

    # A group has at most len(cuts) + 1 chunks, so this window is small.
    counts = marked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunks = counts.select(
        *keys, "_chunk", "_size",
        (F.sum("_size").over(running) - F.col("_size")).alias("_before"),
        F.sum("_size").over(group).alias("_n"),
    )

    # Zero-based fractional rank of each wanted quantile and the two ranks around it.
    def rank(p: float):
        return (F.col("_n") - 1) * F.lit(float(p))

    def inside(target, start):
        return (target >= start) & (target < start + F.col("_size"))

    wanted = [
        inside(r, F.col("_before")) for p in quantiles.values() for r in (F.floor(rank(p)), F.ceil(rank(p)))
    ]
    needed = chunks.where(reduce(lambda a, b: a | b, wanted))
    narrow = keyed_join(marked, needed.select(*keys, "_chunk"), [*keys, "_chunk"], "left_semi")
    values = narrow.groupBy(*keys, "_chunk", "_x").agg(F.count(F.lit(1)).alias("_size"))
    in_chunk = (
        Window.partitionBy(*keys, "_chunk").orderBy("_x")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    values = values.withColumn("_inner", F.sum("_size").over(in_chunk) - F.col("_size"))
    placed = keyed_join(values, needed.drop("_size"), [*keys, "_chunk"]).withColumn(
        "_start", F.col("_before") + F.col("_inner")
    )
    picks = []
    for i, p in enumerate(quantiles.values()):
        for side, r in (("lo", F.floor(rank(p))), ("hi", F.ceil(rank(p)))):
            picks.append(F.max(F.when(inside(r, F.col("_start")), F.col("_x"))).alias(f"_{side}{i}"))
    picked = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    results = []
    for i, (name, p) in enumerate(quantiles.items()):
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        results.append((low + (rank(p) - F.floor(rank(p))) * (high - low)).alias(name))
    return picked.select(*keys, *results)
