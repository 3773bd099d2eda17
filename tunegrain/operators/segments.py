"""Fixed-length summaries of per-segment audio arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.functions import arrays
from tunegrain.schema import CONFIDENCE_GROUPS, SEGMENT_ARRAYS, SEGMENT_DIMS


def array_stats(df: DataFrame, cols: Sequence[str], keep: Sequence[str], with_max: bool = True) -> DataFrame:
    """Mean, population deviation and maximum of array columns, computed inside the row."""
    with_means = df.select(
        *keep,
        *[c for c in cols if c not in keep],
        *[arrays.array_mean(F.col(c)).alias(f"{c}_mean") for c in cols],
    )
    stats: list[Column] = []
    for c in cols:
        mean = F.col(f"{c}_mean")
        stats += [mean, arrays.array_std(F.col(c), mean).alias(f"{c}_std")]
        if with_max:
            stats.append(arrays.array_top(F.col(c)).alias(f"{c}_max"))
    return with_means.select(*keep, *stats)


def grouped_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """The same statistics for values in long form; partial aggregates absorb a hot key."""
    return df.groupBy(key).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max")
    )


def describe_arrays(df: DataFrame, keep: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Array lengths per record; null for a null array."""
    return df.select(*keep, *[F.when(F.col(c).isNotNull(), F.size(c)).alias(f"{c}_size") for c in cols])


def _dim_columns(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    value = F.col(vector)
    return df.select(key, *[F.get(value, F.lit(i)).cast("double").alias(f"d{i}") for i in range(dims)])


def _means(dims: int) -> list[Column]:
    return [F.avg(f"d{i}") for i in range(dims)]


def _covariances(dims: int) -> list[Column]:
    return [F.covar_samp(f"d{i}", f"d{j}") for i in range(dims) for j in range(i, dims)]


def segment_means(df: DataFrame, key: str, vector: str, dims: int = SEGMENT_DIMS) -> DataFrame:
    """(key, means): one vector per input row, averaged per key and dimension."""
    return _dim_columns(df, key, vector, dims).groupBy(key).agg(F.array(*_means(dims)).alias("means"))


def segment_covariances(df: DataFrame, key: str, vector: str, dims: int = SEGMENT_DIMS) -> DataFrame:
    """(key, covariances): upper triangle with diagonal, row by row, of the sample covariance."""
    rows = _dim_columns(df, key, vector, dims)
    return rows.groupBy(key).agg(F.array(*_covariances(dims)).alias("covariances"))


def segment_signature(df: DataFrame, key: str, vector: str, dims: int = SEGMENT_DIMS) -> DataFrame:
    """(key, signature): means followed by covariances, from one aggregation.

    A key with a single segment has null covariances.
    """
    rows = _dim_columns(df, key, vector, dims)
    return rows.groupBy(key).agg(F.array(*_means(dims), *_covariances(dims)).alias("signature"))


def array_signature(df: DataFrame, keep: Sequence[str], cols: Sequence[str], dims: int = SEGMENT_DIMS) -> DataFrame:
    """Flat n x dims arrays replaced by their signatures, inside the row; null without a complete segment."""
    return df.select(*keep, *[arrays.signature(F.col(c), dims).alias(c) for c in cols])


def song_features(raw: DataFrame, key: str = "song_id") -> DataFrame:
    """Raw per-song analysis arrays to the summary columns of the song table, without a shuffle."""
    confidence = [f"{group}_confidence" for group in CONFIDENCE_GROUPS]
    features = array_stats(raw, confidence, [key, "segments_loudness_max", *SEGMENT_ARRAYS])
    rest = [c for c in features.columns if c != "segments_loudness_max"]
    features = array_stats(features, ["segments_loudness_max"], rest, with_max=False)
    return array_signature(features, [c for c in features.columns if c not in SEGMENT_ARRAYS], SEGMENT_ARRAYS)
