"""Scans of Parquet tables, with NaN kept apart from null only where the caller wants it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``; columns and row groups are pruned by the plan that follows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point NaN becomes null, so that SQL aggregates skip it."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.FloatType | T.DoubleType) else F.col(f.name) for f in df.schema.fields])
