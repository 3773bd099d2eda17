"""Ridge regression in closed form and its leave-one-out error."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrain.operators import rowsums


@dataclass
class RidgeModel:
    """y = intercept + x . weights; `inverse` is the inverse of the penalised Gram matrix."""

    weights: np.ndarray
    intercept: float
    x_mean: np.ndarray
    y_mean: float
    inverse: np.ndarray
    rows: int
    features_col: str
    label_col: str

    def transform(self, df: DataFrame, prediction_col: str = "prediction") -> DataFrame:
        """Adds the prediction as a column expression over the feature array."""
        weights = F.array(*[F.lit(float(w)) for w in self.weights])
        products = F.zip_with(rowsums.feature_array(df, self.features_col), weights, lambda a, b: a * b)
        return df.withColumn(prediction_col, F.aggregate(products, F.lit(self.intercept), lambda s, v: s + v))


def fit_ridge(
    train: DataFrame, features_col: str = "features", label_col: str = "label", alpha: float = 0.01,
    per_row: bool = True,
) -> RidgeModel:
    """Solve (X'X + penalty I) w = X'y over centred columns.

    The penalty is alpha * rows with `per_row`, otherwise alpha itself. Two passes: column
    means, then the centred products, whose size is the square of the number of features.
    """
    rows = rowsums.as_rows(train, features_col, label_col)

    def plain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(y), y.sum()], x.sum(axis=0)])

    sums = rowsums.total(rows, plain)
    if sums is None:
        raise ValueError("no complete row to train on")
    n, y_mean, x_mean = int(sums[0]), sums[1] / sums[0], sums[2:] / sums[0]
    width = len(x_mean)

    def centred_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        centred = x - x_mean
        return np.concatenate([(centred.T @ centred).ravel(), centred.T @ (y - y_mean)])

    products = rowsums.total(rows, centred_products)
    gram = products[: width * width].reshape(width, width)
    inverse = np.linalg.inv(gram + alpha * (n if per_row else 1) * np.eye(width))
    weights = inverse @ products[width * width :]
    return RidgeModel(
        weights, float(y_mean - x_mean @ weights), x_mean, float(y_mean), inverse, n, features_col, label_col
    )


def leave_one_out(train: DataFrame, model: RidgeModel) -> DataFrame:
    """(loocv_mse, training_mse): leave-one-out error from the diagonal of the hat matrix.

    Each row's diagonal element needs only the row and the small inverse; the rows x rows
    matrix is never formed.
    """
    x_mean, y_mean, weights, inverse = model.x_mean, model.y_mean, model.weights, model.inverse

    def errors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                centred = rowsums.matrix(batch.column(0)) - x_mean
                residual = rowsums.vector(batch.column(1)) - y_mean - centred @ weights
                leverage = ((centred @ inverse) * centred).sum(axis=1)
                columns = [pa.array((residual / (1.0 - leverage)) ** 2), pa.array(residual**2)]
                yield pa.RecordBatch.from_arrays(columns, ["loo", "fit"])

    rows = rowsums.as_rows(train, model.features_col, model.label_col)
    return rows.mapInArrow(errors, "loo double, fit double").agg(
        F.avg("loo").alias("loocv_mse"), F.avg("fit").alias("training_mse")
    )
