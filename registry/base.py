"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.sources import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def add(name: str, run: Query, twin: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = run
    if twin is not None:
        TWINS[name] = twin


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (engines differ in the last bits), other numbers as bigint."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        columns.append(column.alias(name))
    return df.select(*columns)


def on_swabs(step: Callable[[DataFrame], DataFrame], digits: int = 6) -> Query:
    return lambda spark, folder: tidy(step(views.swabs(spark, folder)), digits)


def on_subjects(step: Callable[[DataFrame], DataFrame], digits: int = 6) -> Query:
    return lambda spark, folder: tidy(step(views.subjects(spark, folder)), digits)


def on_both(step: Callable[[DataFrame, DataFrame], DataFrame], digits: int = 6) -> Query:
    return lambda spark, folder: tidy(step(views.swabs(spark, folder), views.subjects(spark, folder)), digits)
