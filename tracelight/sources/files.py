"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with an explicit schema; ``NA`` and empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)


def infer_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with types inferred by an extra pass over the file."""
    return (
        spark.read.option("header", True).option("inferSchema", True).option("nullValue", "NA").csv(path)
    )


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a finished table as Parquet or header CSV."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
