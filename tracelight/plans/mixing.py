"""Rank-normalised convergence and effective sample sizes of draws (model_name, chain, iteration, param, value).

Values are replaced by normal scores of their average ranks over all chains, ranked in
ranges and counted by value, so no task sorts a parameter. Autocovariances come from one
Fourier transform a chain (a half-chain lies in one row, as long as the sampler ran);
they meet as narrow rows by lag, and Geyer's initial monotone sequence is a running
minimum over pairs of lags.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.functions import inverse_normal
from tracelight.operators.groups import range_ranks
from tracelight.operators.joins import keyed_join
from tracelight.plans.checks import RHAT_LIMIT

PARAMETER = ["model_name", "param"]
CHAIN = [*PARAMETER, "chain", "half"]


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``rank`` (from 1; equal values share their mean) and ``n`` within each group of any size."""
    keys = list(keys)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_times"))
    ranked = range_ranks(distinct, keys, value)
    # Counts before a value: running sums of the values' counts, by the place of the value.
    order = Window.partitionBy(*keys).orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("_times").over(order)
    places = ranked.select(*keys, value, (upto - (F.col("_times") - 1) / 2).alias("rank"))
    sizes = df.groupBy(*keys).agg(F.count(value).alias("n"))
    return keyed_join(keyed_join(df, places, [*keys, value]), sizes, keys)


def normal_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``, the normal score of the value's rank in its group."""
    ranked = average_ranks(df, keys, value)
    return ranked.withColumn(name, inverse_normal((F.col("rank") - 0.375) / (F.col("n") + 0.25))).drop("rank", "n")


def halved(draws: DataFrame) -> DataFrame:
    """``draws`` with ``half``: whether a row lies after the middle iteration of its chain."""
    keys = ["model_name", "chain"]
    span = draws.groupBy(*keys).agg(((F.min("iteration") + F.max("iteration")) / 2).alias("_middle"))
    return keyed_join(draws, span, keys).withColumn("half", F.col("iteration") > F.col("_middle")).drop("_middle")


def _variances(rows: DataFrame, value: str) -> DataFrame:
    """(parameter, within, total, draws, length, chains): chain variance, and with that of the chain means."""
    each = rows.groupBy(*CHAIN).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.count(value).alias("count"))
    pooled = each.groupBy(*PARAMETER).agg(
        F.avg("var").alias("within"), F.coalesce(F.var_samp("mean"), F.lit(0.0)).alias("between"), F.sum("count").alias("draws"),
        F.avg("count").alias("length"), F.min("count").alias("shortest"), F.count(F.lit(1)).alias("chains"),
    )
    return pooled.withColumn("total", (F.col("length") - 1) / F.col("length") * F.col("within") + F.col("between"))


def _ratio(rows: DataFrame, value: str, name: str) -> DataFrame:
    found = _variances(rows, value)
    return found.select(*PARAMETER, F.sqrt(F.col("total") / F.nullif("within", F.lit(0.0))).alias(name))


def _scored(draws: DataFrame) -> DataFrame:
    """``draws`` with ``z`` (normal ranks) and ``folded`` (normal ranks of the distance from the median)."""
    rows = halved(draws)
    middle = rows.groupBy(*PARAMETER).agg(F.median("value").alias("_median"))
    rows = keyed_join(rows, middle, PARAMETER).withColumn("_away", F.abs(F.col("value") - F.col("_median")))
    return normal_ranks(normal_ranks(rows, PARAMETER, "value", "z"), PARAMETER, "_away", "folded").drop("_away", "_median")


def rank_convergence(draws: DataFrame) -> DataFrame:
    """Per parameter: the larger split-chain variance ratio of normal ranks and of folded ones."""
    rows = _scored(draws)
    both = keyed_join(_ratio(rows, "z", "bulk"), _ratio(rows, "folded", "tail"), PARAMETER)
    return both.select(*PARAMETER, F.greatest("bulk", "tail").alias("rhat")).withColumn("converged", F.col("rhat") < RHAT_LIMIT)


def _autocovariances(rows: DataFrame, value: str) -> DataFrame:
    """(parameter, lag, acov): biased autocovariances averaged over half-chains, for lags that all of them have."""
    lists = rows.groupBy(*CHAIN).agg(F.sort_array(F.collect_list(F.struct("iteration", F.col(value).alias("v")))).alias("chain_rows"))
    lists = lists.select(F.struct(*PARAMETER).alias("key"), F.col("chain_rows.v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.column("v")[row].values.to_numpy(zero_copy_only=False)
                n = len(x)
                size = 1 << (2 * n - 1).bit_length()
                wave = np.fft.rfft(x - x.mean(), size)
                acov = np.fft.irfft(wave * wave.conj(), size)[:n] / n
                key = batch.column("key").take(pa.array(np.full(n, row)))
                yield pa.RecordBatch.from_arrays([key, pa.array(np.arange(n)), pa.array(acov)], names=["key", "lag", "acov"])

    from pyspark.sql.types import StructType

    schema = StructType([lists.schema["key"]]).add("lag", "long").add("acov", "double")
    spread = lists.mapInArrow(run, schema).select("key.*", "lag", "acov")
    return spread.groupBy(*PARAMETER, "lag").agg(F.avg("acov").alias("acov"))


def effective_size(rows: DataFrame, value: str) -> DataFrame:
    """(parameter, size): draws over the integrated autocorrelation time, by the initial monotone sequence."""
    stats = _variances(rows, value)
    lags = keyed_join(_autocovariances(rows, value), stats, PARAMETER).where(F.col("lag") < F.col("shortest"))
    rho = F.when(F.col("lag") == 0, 1.0).otherwise(1 - (F.col("within") - F.col("acov")) / F.nullif("total", F.lit(0.0)))
    pairs = lags.withColumn("rho", rho).groupBy(*PARAMETER, F.floor(F.col("lag") / 2).alias("k")).agg(
        F.sum("rho").alias("pair"), F.count(F.lit(1)).alias("lags"), F.first("draws").alias("draws"))
    order = Window.partitionBy(*PARAMETER).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.min("pair").over(order)
    kept = pairs.where("lags = 2").withColumn("least", least).where("least > 0")
    time = kept.groupBy(*PARAMETER).agg((2 * F.sum("least") - 1).alias("time"))
    found = keyed_join(stats, time, PARAMETER)
    shortest = 1 / F.log10(F.col("draws"))
    size = F.when(F.col("total") > 0, F.col("draws") / F.greatest(F.coalesce("time", shortest), shortest))
    return found.select(*PARAMETER, size.alias("size"))


def effective_sizes(draws: DataFrame) -> DataFrame:
    """Per parameter: ``ess_bulk`` (normal ranks) and ``ess_tail`` (the smaller of both 5 % tails)."""
    rows = _scored(draws)
    limits = draws.groupBy(*PARAMETER).agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("_q"))
    rows = keyed_join(rows, limits, PARAMETER)
    below: list[tuple[str, Column]] = [(f"below{i}", (F.col("value") <= F.col("_q")[i]).cast("double")) for i in (0, 1)]
    rows = rows.withColumns(dict(below))
    found = effective_size(rows, "z").withColumnRenamed("size", "ess_bulk")
    for i in (0, 1):
        found = keyed_join(found, effective_size(rows, f"below{i}").withColumnRenamed("size", f"_t{i}"), PARAMETER)
    return found.select(*PARAMETER, "ess_bulk", F.least("_t0", "_t1").alias("ess_tail"))
