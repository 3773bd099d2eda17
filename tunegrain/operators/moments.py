"""Principal components from stored summaries of batches.

A batch is summed up by its row count, a reference point, and the sums and products of its rows about that point. Summaries
of one run are kept as a table, those of later runs are added to it, and components are fitted from all of them without
reading a row again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrain.operators import rowsums

_SCHEMA = "batch string, n long, point array<double>, sums array<double>, products array<double>"


def add_batch(rows: DataFrame, features_col: str, path: str, batch: str) -> None:
    """Write the summary of `rows` as `batch` below `path`; a batch that is added again replaces its first summary.

    Rows with a null or NaN feature are left out; a batch without any row is kept with a count of 0. The products are taken about the
    batch's mean, so large values cost no digits.
    """
    spark = rows.sparkSession
    plain = rowsums.as_rows(rows.withColumn("_zero", F.lit(0.0)), features_col, "_zero")
    found = rowsums.total(plain, lambda x, y: np.concatenate([[len(x)], x.sum(axis=0)]))
    if found is None:
        row = (batch, 0, [], [], [])
    else:
        point = found[1:] / found[0]

        def about(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            centred = x - point
            return np.concatenate([centred.sum(axis=0), (centred.T @ centred).ravel()])

        sums = rowsums.total(plain, about)
        row = (batch, int(found[0]), point.tolist(), sums[: len(point)].tolist(), sums[len(point):].tolist())
    spark.createDataFrame([row], _SCHEMA).write.mode("overwrite").parquet(f"{path}/{batch}")


@dataclass
class Components:
    """`vectors` (k x features) are orthonormal, by falling variance; `variances` are theirs, `total` that of all features."""

    n: int
    mean: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    total: float

    def project(self, df: DataFrame, features_col: str, output_col: str) -> DataFrame:
        mean, vectors = self.mean, self.vectors

        @F.arrow_udf("array<double>")
        def apply(values: pa.Array) -> pa.Array:
            found = (rowsums.matrix(values) - mean) @ vectors.T if len(values) else np.zeros((0, len(vectors)))
            return pa.array(list(found), pa.list_(pa.float64()))

        return df.withColumn(output_col, apply(rowsums.feature_array(df, features_col)))


def fit_components(spark: SparkSession, path: str, k: int) -> Components:
    """The `k` leading components of all batches below `path`; only features x features sums come to the driver."""
    batches = spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").parquet(path).filter("n > 0")
    first = batches.orderBy("batch").select("point").first()
    if first is None:
        raise ValueError("no row to fit")
    base = np.array(first["point"])
    width = len(base)
    flat = F.concat(F.array(F.col("n").cast("double")), "point", "sums", "products")

    def shifted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums and products of each summary about `base`."""
        out = np.zeros(1 + width + width * width)
        for row in x:
            n, by = row[0], row[1: 1 + width] - base
            sums, products = row[1 + width: 1 + 2 * width], row[1 + 2 * width:].reshape(width, width)
            cross = np.outer(sums, by)
            out += np.concatenate([[n], sums + n * by, (products + cross + cross.T + n * np.outer(by, by)).ravel()])
        return out

    merged = rowsums.total(batches.select(flat.alias("x"), F.lit(0.0).alias("y")), shifted)
    n, sums, products = merged[0], merged[1: 1 + width], merged[1 + width:].reshape(width, width)
    covariance = (products - np.outer(sums, sums) / n) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:k]
    return Components(int(n), base + sums / n, vectors[:, order].T, values[order], float(np.trace(covariance)))


def kept_and_left(df: DataFrame, features_col: str, mean: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """`df` with kept and left: squared lengths, about `mean`, of a row's projection and of what the projection leaves of it.

    Their sum is the row's whole squared length only if the vectors are orthonormal.
    """

    @F.arrow_udf("array<double>")
    def parts(values: pa.Array) -> pa.Array:
        centred = rowsums.matrix(values) - mean if len(values) else np.zeros((0, len(mean)))
        inside = centred @ vectors.T
        rest = centred - inside @ vectors
        return pa.array(list(np.stack([(inside**2).sum(axis=1), (rest**2).sum(axis=1)], 1)), pa.list_(pa.float64()))

    both = df.withColumn("_parts", parts(rowsums.feature_array(df, features_col)))
    return both.withColumns({"kept": F.col("_parts")[0], "left": F.col("_parts")[1]}).drop("_parts")
