"""Null-safe equi-joins that stay balanced when one key holds much of the data.

No side is broadcast on trust: a short lookup is counted first, otherwise Spark picks a broadcast by measured size
(``spark.sql.autoBroadcastJoinThreshold``, re-checked at run time by adaptive
execution) and a shuffle join beyond it. A key with more than ``slice_rows``
left rows is cut into slices first, so no shuffle partition grows with it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.session import cut_lineage

SLICE_ROWS = 5_000_000
#: Rows of a lookup that may be sent to every task.
LOOKUP_ROWS = 50_000


def same_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality of key pairs in which null matches null."""
    return reduce(lambda a, b: a & b, [left[l].eqNullSafe(right[r]) for l, r in pairs])


def keyed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join on equally named keys, keeping the left copy of each key.

    Skew is left to adaptive execution; see ``spread_join`` for explicit slices.
    """
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    joined = left.join(renamed, same_keys(left, renamed, [(k, f"_r_{k}") for k in on]), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in on])


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    rows: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``keyed_join`` with heavy keys cut into slices of about ``slice_rows`` rows.

    ``rows`` names a column of ``right`` that already holds the left row count of
    the key (dropped from the result); otherwise the counts come from ``left``,
    reduced map-side. Only heavy keys are broadcast: there are at most
    ``left rows / slice_rows`` of them, a few hundred kilobytes at 10^10 rows.
    The slice of a row is a hash of its columns, so a retried task repeats it.
    """
    on = list(on)
    slices = F.ceil(F.col("_rows") / F.lit(slice_rows)).cast("int")
    if rows is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    else:
        counts = right.select(*on, F.col(rows).alias("_rows"))
        right = right.drop(rows)
    heavy = counts.where(F.col("_rows") > slice_rows).select(*on, slices.alias("_slices"))
    heavy = F.broadcast(heavy)
    spread = F.pmod(F.xxhash64(*left.columns), F.coalesce(F.col("_slices"), F.lit(1)))
    left = keyed_join(left, heavy, on).withColumn("_slice", spread.cast("int")).drop("_slices")
    last = F.coalesce(F.col("_slices"), F.lit(1)) - 1
    right = (
        keyed_join(right, heavy, on)
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), last)))
        .drop("_slices")
    )
    return keyed_join(left, right, [*on, "_slice"], how).drop("_slice")


def with_group_stats(
    df: DataFrame,
    keys: Sequence[str],
    stats: dict[str, Column],
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """Add per-group aggregates to every row without sorting any group in one task.

    A window over the group would pull all its rows together; here the groups are
    reduced map-side and the one row per group is joined back. ``slice_rows=None``
    leaves the balance of the join to adaptive execution.
    """
    aggregates = [column.alias(name) for name, column in stats.items()]
    if slice_rows is None:
        return keyed_join(df, df.groupBy(*keys).agg(*aggregates), keys)
    grouped = df.groupBy(*keys).agg(*aggregates, F.count(F.lit(1)).alias("_group_rows"))
    return spread_join(df, grouped, keys, rows="_group_rows", slice_rows=slice_rows)


def subject_attributes(swabs: DataFrame, subjects: DataFrame, columns: Sequence[str], key: str = "redcap_id") -> DataFrame:
    """Left join of subject columns; a null key matches a null key."""
    return spread_join(swabs, subjects.select(key, *columns), [key])


def group_lookup(df: DataFrame, source: DataFrame, keys: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Aggregate ``source`` by ``keys`` and left join the result to ``df``.

    ``df`` is a result table with few rows per key, so the join needs no slices.
    """
    return keyed_join(df, source.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys)


def distinct_lookup(
    df: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str], most: int = LOOKUP_ROWS
) -> DataFrame:
    """Left join distinct (keys, columns) rows; a key with several rows fans out.

    Every key of a short lookup is heavy, so slicing would not help. The lookup is
    written and counted: up to ``most`` rows go to every task, and nothing of ``df`` is
    shuffled; beyond that adaptive execution splits skewed partitions.
    """
    lookup = cut_lineage(source.select(*keys, *columns).distinct())
    return keyed_join(df, F.broadcast(lookup) if lookup.count() <= most else lookup, keys)


def one_per_key(source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key, taking the smallest combination of ``columns``."""
    smallest = F.min(F.struct(*columns)).alias("_first")
    grouped = source.groupBy(*keys).agg(smallest)
    return grouped.select(*keys, *[F.col("_first")[c].alias(c) for c in columns])
