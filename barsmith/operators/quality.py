"""Data-quality checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _verdict(failures: DataFrame, check: str) -> DataFrame:
    return failures.select(F.lit(check).alias("check_name"), "failures",
                           (F.col("failures") != 0).alias("should_warn"),
                           (F.col("failures") != 0).alias("should_error"))


def check_not_null(df: DataFrame, column: str) -> DataFrame:
    """Rows without a value."""
    return _verdict(df.agg(F.count_if(F.col(column).isNull()).alias("failures")),
                    f"not_null_{column}")


def check_unique(df: DataFrame, *columns: str) -> DataFrame:
    """Values held by more than one row; the counts are combined before the shuffle."""
    present = df.dropna(subset=list(columns))
    repeats = present.groupBy(*columns).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    return _verdict(repeats.agg(F.count("*").alias("failures")), f"unique_{'_'.join(columns)}")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns the frame lacks, known before any job runs."""
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def missing_tables(spark: SparkSession, names: Iterable[str]) -> list[str]:
    return [n for n in names if not spark.catalog.tableExists(n)]
