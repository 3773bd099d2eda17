"""Sums of per-row arrays over a whole table, the data-sized step of the custom trainers.

Each task folds its rows into one array with numpy; the arrays of all tasks are then added up
in two steps, so that neither one task nor the driver ever receives one array per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 32

Fold = Callable[..., np.ndarray]


def feature_array(df: DataFrame, features_col: str) -> Column:
    if df.schema[features_col].dataType.simpleString() == "vector":
        return vector_to_array(F.col(features_col))
    return F.col(features_col).cast("array<double>")


def as_rows(df: DataFrame, features_col: str, label_col: str, *keep: Column) -> DataFrame:
    """(x, y, ...): features as a plain array and the label, without rows that hold a null or NaN."""
    rows = df.select(feature_array(df, features_col).alias("x"), F.col(label_col).cast("double").alias("y"), *keep)
    gap = F.exists("x", lambda v: v.isNull() | F.isnan(v))
    return rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y") & ~gap)


def matrix(values: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a rows x width matrix; other lengths are an error."""
    lengths = values.value_lengths()
    if len(lengths) and pc.min(lengths) != pc.max(lengths):
        raise ValueError(f"feature lists of {pc.min(lengths)} to {pc.max(lengths)} values in one table")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def vector(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def total(rows: DataFrame, fold: Fold, scan: bool = False) -> np.ndarray | None:
    """Sum of `fold(x, y, ...)` over all batches of rows (x, y, ...), None without any row.

    All folds must return arrays of one length. With `scan`, `rows` is a plain file scan: its
    number of tasks is known beforehand, and up to FAN_IN arrays go straight to the driver.
    """

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            if batch.num_rows:
                yield fold(matrix(batch.column(0)), *[vector(c) for c in batch.columns[1:]])

    return total_of(rows, folded, scan)


def total_of(rows: DataFrame, folded: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]], scan: bool = False) -> np.ndarray | None:
    """Sum of the arrays of one length that `folded` makes of each task's batches, as `total` adds them up."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for part in folded(batches):
            acc = part if acc is None else acc + part
        if acc is not None:
            lists = pa.ListArray.from_arrays(pa.array([0, len(acc)], pa.int32()), pa.array(acc))
            yield pa.RecordBatch.from_arrays([lists], ["v"])

    parts = rows.mapInArrow(partial, "v array<double>")
    if scan and rows.rdd.getNumPartitions() <= FAN_IN:
        sums = [np.asarray(row["v"]) for row in parts.collect()]
    else:
        group = F.pmod(F.spark_partition_id(), F.lit(FAN_IN))
        joined = (
            parts.select(group.alias("g"), array_to_vector("v").alias("v"))
            .groupBy("g")
            .agg(Summarizer.sum(F.col("v")).alias("v"))
        )
        sums = [row["v"].toArray() for row in joined.collect()]  # at most FAN_IN rows
    return np.sum(sums, axis=0) if sums else None
