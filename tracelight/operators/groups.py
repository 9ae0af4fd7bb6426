"""Group starts, offsets, dense ids and standard scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.operators.joins import SLICE_ROWS, keyed_join, with_group_stats
from tracelight.session import cut_lineage


def first_samples(
    swabs: DataFrame,
    keys: Sequence[str] = ("subject_room_id",),
    day: str = "subject_room_day",
    strict_na: bool = False,
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """Rows at the smallest day of their group, ties kept.

    ``strict_na=True`` drops every row of a group that holds a null day, as a
    minimum that does not skip missing values would.
    """
    stats = {"_first_day": F.min(day)}
    if strict_na:
        stats["_gaps"] = F.count_if(F.col(day).isNull())
    marked = with_group_stats(swabs, keys, stats, slice_rows)
    keep = F.col(day) == F.col("_first_day")
    if strict_na:
        keep = keep & (F.col("_gaps") == 0)
    return marked.where(keep).drop(*stats)


def offset_from_start(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    name: str,
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """``column`` minus its group minimum."""
    marked = with_group_stats(df, keys, {"_start": F.min(column)}, slice_rows)
    return marked.withColumn(name, F.col(column) - F.col("_start")).drop("_start")


def range_ranks(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str] = ()) -> DataFrame:
    """Add ``_rank`` (from 1, ascending) and ``_n`` within each group of any size.

    The rows are range-partitioned by group and value and written once; each range
    is numbered on its own and the counts of the group's earlier ranges are added.
    No task sorts a whole group.
    """
    keys = list(keys)
    ranges = cut_lineage(
        df.repartitionByRange(*keys, value, *tie).withColumn("_range", F.spark_partition_id())
    )
    sizes = ranges.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select(
        *keys, "_range", (F.sum("_size").over(running) - F.col("_size")).alias("_start"),
        F.sum("_size").over(group).alias("_n"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value, *tie)
    numbered = ranges.withColumn("_position", F.row_number().over(inside))
    joined = keyed_join(numbered, starts, [*keys, "_range"])
    return joined.withColumn("_rank", F.col("_start") + F.col("_position")).drop("_range", "_start", "_position")


def dense_ids(df: DataFrame, key: Column, name: str = "id") -> DataFrame:
    """Consecutive numbers from 1 for the distinct keys in sort order, as (key, name)."""
    keys = df.select(key.alias("key")).where(F.col("key").isNotNull()).distinct()
    return range_ranks(keys, [], "key").select("key", F.col("_rank").alias(name))


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: mean and sample standard deviation."""
    return df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))


def standard_score(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """z-score over the whole table, taken before any row is dropped."""
    stats = column_stats(df, column)
    mean, sd = stats.select("mean").scalar(), stats.select("sd").scalar()
    return df.withColumn(name or column, (F.col(column) - mean) / F.nullif(sd, F.lit(0.0)))


def undo_standard_score(df: DataFrame, column: str, source: DataFrame, source_column: str, name: str | None = None) -> DataFrame:
    """Back to the units of ``source_column`` of the unscaled table ``source``."""
    stats = column_stats(source, source_column)
    mean, sd = stats.select("mean").scalar(), stats.select("sd").scalar()
    return df.withColumn(name or column, F.col(column) * sd + mean)
