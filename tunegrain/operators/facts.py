"""Fact queries: age range, largest groups, top rows, year profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.functions import years
from tunegrain.operators.quantiles import exact_percentiles


def age_range(df: DataFrame, year_col: str = "year", ref_year: int = 2025) -> DataFrame:
    """Age of the youngest and the oldest song among those with a positive year."""
    year = F.col(year_col)
    return df.filter(year > 0).agg(
        (F.lit(ref_year) - F.max(year)).alias("youngest_song_age"),
        (F.lit(ref_year) - F.min(year)).alias("oldest_song_age"),
    )


def top_rows(df: DataFrame, order: Sequence[Column], n: int = 10) -> DataFrame:
    """First `n` rows; every task keeps only its own first `n` before the merge."""
    return df.orderBy(*order).limit(n)


def hottest_songs(df: DataFrame, n: int = 10) -> DataFrame:
    """Hottest first, then shortest, most energetic and slowest; `song_id` settles full ties."""
    order = [
        F.col("song_hotttnesss").desc_nulls_last(),
        F.col("duration").asc_nulls_last(),
        F.col("energy").desc_nulls_last(),
        F.col("tempo").asc_nulls_last(),
        F.col("song_id").asc_nulls_last(),
    ]
    return top_rows(not_nan(df, "song_hotttnesss"), order, n).select("song_id", "title")


def not_nan(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col)))


def top_groups(df: DataFrame, key: str, n: int = 1, count_name: str = "n") -> DataFrame:
    """Groups with most non-null keys; ties go to the smaller key."""
    counted = df.groupBy(key).agg(F.count(key).alias(count_name))
    return top_rows(counted, [F.col(count_name).desc(), F.col(key).asc_nulls_last()], n)


def longest_row(df: DataFrame, value: str, keep: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The row with the largest `value`; unknown values never win."""
    order = [F.col(value).desc_nulls_last()] + [F.col(c).asc_nulls_last() for c in tie]
    return top_rows(df, order, 1).select(*keep)


def year_profile(df: DataFrame, year_col: str = "year") -> DataFrame:
    return df.agg(
        F.min(year_col).alias("min_year"),
        F.max(year_col).alias("max_year"),
        F.count(year_col).alias("total_records"),
    )


def decade_histogram(df: DataFrame, year_col: str = "year") -> DataFrame:
    year = F.col(year_col)
    return (
        df.filter(years.is_known(year))
        .groupBy(years.decade(year).alias("decade"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("decade")
    )


def label_summary(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of one column, in one row."""
    base = df.agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )
    found = {(r["column"], r["prob"]): r["value"] for r in exact_percentiles(df, [col], [0.25, 0.5, 0.75]).collect()}
    return base.select(
        "n", "mean", "std", "min",
        *[F.lit(found[(col, p)]).cast("double").alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)],
        "max",
    )
