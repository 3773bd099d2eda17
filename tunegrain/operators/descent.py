"""Gradient-trained regressors that Spark ML lacks: mini-batch SGD and a multi-layer perceptron.

The training table is written once, split by key hash into mini-batch folders. A step reads only
its own folder (partition pruning), adds up the gradients of that batch on the executors, and
updates the weights on the driver. Steps depend on the rows only, not on how they are laid out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrain.functions.hashing import HASH_BITS, fraction_cut, key_hash
from tunegrain.operators import rowsums
from tunegrain.runtime import materialize

VALIDATION = -1
# Sums of products that are brought to the driver for all batches together, at most.
MOMENT_VALUES = 4_000_000


def batch_table(
    train: DataFrame, features_col: str, label_col: str, key: str, batches: int, validation: float, seed: int
) -> DataFrame:
    """(x, y, batch): rows spread over `batches` by hash; batch -1 is held out for validation."""
    slot = F.floor(key_hash(key, seed) * F.lit(batches / 2.0**HASH_BITS)).cast("int")
    batch = F.when(key_hash(key, seed + 1) < fraction_cut(validation), F.lit(VALIDATION)).otherwise(
        F.least(slot, F.lit(batches - 1))
    )
    rows = rowsums.as_rows(train, features_col, label_col, batch.alias("batch"))
    # Rebalancing gives every folder few files of full size, and splits a folder over several tasks.
    return materialize(rows.hint("rebalance", "batch"), "batches", partition_by="batch")


def _batch(table: DataFrame, *numbers: int) -> DataFrame:
    return table.filter(F.col("batch").isin(*numbers))


def _with_prediction(
    df: DataFrame, features_col: str, prediction_col: str, forward: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    """Vectorised prediction in Arrow batches; all columns of `df` pass through."""

    @F.arrow_udf("double")
    def predict(values: pa.Array) -> pa.Array:
        return pa.array(forward(rowsums.matrix(values)) if len(values) else [], pa.float64())

    return df.withColumn(prediction_col, predict(rowsums.feature_array(df, features_col)))


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    def _name(self, features_col: str, label_col: str, prediction_col: str) -> None:
        self._set(featuresCol=features_col, labelCol=label_col, predictionCol=prediction_col)


class LinearModel(Model, _Columns):
    def __init__(self, weights: np.ndarray, intercept: float, names: Sequence[str]) -> None:
        super().__init__()
        self.weights, self.intercept = weights, intercept
        self._name(*names)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, intercept = self.weights, self.intercept
        return _with_prediction(
            dataset, self.getFeaturesCol(), self.getPredictionCol(), lambda x: x @ weights + intercept
        )


class SGDRegressor(Estimator, _Columns):
    """Least squares by mini-batch gradient steps of size step / sqrt(t).

    `key` identifies a row and decides its mini-batch. With `penalty="l2"` weights also decay
    by `reg`; without one `reg` has no effect.
    """

    def __init__(
        self, key: str, features_col: str = "features", label_col: str = "label", prediction_col: str = "prediction",
        steps: int = 800, step: float = 0.2, batch_fraction: float = 0.1, reg: float = 0.001,
        penalty: str | None = None, intercept: bool = False, decay: bool = True, seed: int = 42,
    ) -> None:
        super().__init__()
        self._name(features_col, label_col, prediction_col)
        self.key, self.steps, self.step, self.batch_fraction = key, steps, step, batch_fraction
        self.reg, self.penalty, self.intercept, self.decay, self.seed = reg, penalty, intercept, decay, seed

    def _fit(self, dataset: DataFrame) -> LinearModel:
        batches = max(1, round(1.0 / self.batch_fraction))
        names = (self.getFeaturesCol(), self.getLabelCol(), self.getPredictionCol())
        table = batch_table(dataset, names[0], names[1], self.key, batches, 0.0, self.seed)
        width = len(table.select("x").first()["x"])
        # A batch's gradient is linear in the weights: with its sums of products at hand no step reads rows.
        small = batches * (width + 2) ** 2 <= MOMENT_VALUES
        moments = self._moments(table, batches, width) if small else None
        weights, intercept = np.zeros(width), 0.0
        for t in range(1, self.steps + 1):
            number = (t - 1) % batches

            def gradient(x: np.ndarray, y: np.ndarray, w=weights, b=intercept) -> np.ndarray:
                error = x @ w + b - y
                return np.concatenate([[len(y), error.sum()], x.T @ error])

            if moments is None:
                sums = rowsums.total(_batch(table, number).select("x", "y"), gradient, scan=True)
            else:
                own = moments[number]
                error = own @ np.concatenate([weights, [intercept, -1.0]])
                sums = np.concatenate([[own[-2, -2], error[-2]], error[:-2]]) if own[-2, -2] else None
            if sums is None:  # a tiny table may leave a batch empty
                continue
            rate = self.step / np.sqrt(t) if self.decay else self.step
            shrink = 1.0 - rate * self.reg if self.penalty == "l2" else 1.0
            weights = weights * shrink - rate * sums[2:] / sums[0]
            if self.intercept:
                intercept -= rate * sums[1] / sums[0]
        return LinearModel(weights, float(intercept), names)

    @staticmethod
    def _moments(table: DataFrame, batches: int, width: int) -> np.ndarray:
        """For each batch the sums of products of (features, 1, label) with each other, from one pass."""
        def products(x: np.ndarray, y: np.ndarray, batch: np.ndarray) -> np.ndarray:
            rows = np.column_stack([x, np.ones(len(y)), y])
            out = np.zeros((batches, width + 2, width + 2))
            for number in np.unique(batch):
                own = rows[batch == number]
                out[int(number)] = own.T @ own
            return out.ravel()

        return rowsums.total(table.select("x", "y", "batch"), products).reshape(batches, width + 2, width + 2)


def _unpack(flat: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        weight = flat[at : at + n_in * n_out].reshape(n_in, n_out)
        at += n_in * n_out
        out.append((weight, flat[at : at + n_out]))
        at += n_out
    return out


def _activations(x: np.ndarray, flat: np.ndarray, layers: Sequence[int]) -> list[np.ndarray]:
    """Inputs of every layer and the linear output."""
    steps = _unpack(flat, layers)
    values = [x]
    for i, (weight, bias) in enumerate(steps):
        z = values[-1] @ weight + bias
        values.append(np.maximum(z, 0.0) if i < len(steps) - 1 else z)
    return values


def _loss_gradient(x: np.ndarray, y: np.ndarray, flat: np.ndarray, layers: Sequence[int]) -> np.ndarray:
    """[rows, squared error, gradient...] of half the squared error, summed over the rows."""
    values = _activations(x, flat, layers)
    delta = values[-1] - y[:, None]
    loss = float((delta**2).sum())
    parts: list[np.ndarray] = []
    steps = _unpack(flat, layers)
    for i in range(len(steps) - 1, -1, -1):
        parts[:0] = [(values[i].T @ delta).ravel(), delta.sum(axis=0)]
        if i:
            delta = (delta @ steps[i][0].T) * (values[i] > 0)
    return np.concatenate([[len(y), loss], *parts])


class PerceptronModel(Model, _Columns):
    def __init__(
        self, flat: np.ndarray, layers: Sequence[int], names: Sequence[str], losses: list[float], checks: list[float]
    ) -> None:
        super().__init__()
        self.flat, self.layers = flat, list(layers)
        self.losses, self.validation_errors = losses, checks
        self._name(*names)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        flat, layers = self.flat, self.layers
        return _with_prediction(
            dataset, self.getFeaturesCol(), self.getPredictionCol(), lambda x: _activations(x, flat, layers)[-1][:, 0]
        )


class PerceptronRegressor(Estimator, _Columns):
    """Multi-layer perceptron with rectified units, trained by Adam on synchronous mini-batches.

    `key` identifies a row. One epoch walks over `batches` mini-batches, by default as many as
    give about `batch_rows` rows each. With
    `early_stopping`, training ends after `patience` epochs without a better error on the
    held-out share `validation`, and the best weights are kept.
    """

    def __init__(
        self, key: str, features_col: str = "features", label_col: str = "label", prediction_col: str = "prediction",
        hidden: Sequence[int] = (100, 50), epochs: int = 200, batches: int | None = None, batch_rows: int = 65_536, rate: float = 0.001,
        alpha: float = 0.0001, early_stopping: bool = True, validation: float = 0.1, patience: int = 10,
        tol: float = 1e-4, seed: int = 42,
    ) -> None:
        super().__init__()
        self._name(features_col, label_col, prediction_col)
        self.key, self.hidden, self.epochs, self.rate = key, list(hidden), epochs, rate
        self.batches, self.batch_rows = batches, batch_rows
        self.alpha, self.early_stopping, self.validation = alpha, early_stopping, validation
        self.patience, self.tol, self.seed = patience, tol, seed

    def _start(self, layers: Sequence[int]) -> np.ndarray:
        random = np.random.default_rng(self.seed)
        parts = []
        for n_in, n_out in zip(layers, layers[1:]):
            bound = np.sqrt(6.0 / (n_in + n_out))
            parts += [random.uniform(-bound, bound, n_in * n_out), random.uniform(-bound, bound, n_out)]
        return np.concatenate(parts)

    def _fit(self, dataset: DataFrame) -> PerceptronModel:
        names = (self.getFeaturesCol(), self.getLabelCol(), self.getPredictionCol())
        held_out = self.validation if self.early_stopping else 0.0
        batches = self.batches or max(1, -(-dataset.count() // self.batch_rows))
        table = batch_table(dataset, names[0], names[1], self.key, batches, held_out, self.seed)
        layers = [len(table.select("x").first()["x"]), *self.hidden, 1]
        flat = self._start(layers)
        decayed = np.concatenate([
            np.concatenate([np.full(n_in * n_out, self.alpha), np.zeros(n_out)])
            for n_in, n_out in zip(layers, layers[1:])
        ])
        first, second = np.zeros_like(flat), np.zeros_like(flat)
        best, best_error, waited, t = flat, np.inf, 0, 0
        losses, checks = [], []

        def step(x: np.ndarray, y: np.ndarray, batch: np.ndarray, w: np.ndarray) -> np.ndarray:
            """[held-out rows, their squared error, rows, squared error, gradient...]."""
            held = batch == VALIDATION
            error = _activations(x[held], w, layers)[-1][:, 0] - y[held]
            return np.concatenate([[held.sum(), (error**2).sum()], _loss_gradient(x[~held], y[~held], w, layers)])

        for _ in range(self.epochs):
            rows = loss = 0.0
            for number in range(batches):
                # The first step of an epoch also scores the weights that the epoch starts from.
                parts = [number, VALIDATION] if self.early_stopping and number == 0 else [number]
                sums = rowsums.total(_batch(table, *parts), lambda x, y, b, w=flat: step(x, y, b, w), scan=True)
                if sums is None:  # a tiny table may leave a batch empty
                    continue
                if number == 0 and sums[0]:
                    error = sums[1] / sums[0]
                    checks.append(error)
                    waited = 0 if error < best_error - self.tol * min(best_error, 1.0) else waited + 1
                    if error < best_error:
                        best, best_error = flat, error
                if not sums[2]:
                    continue
                rows, loss, t = rows + sums[2], loss + sums[3], t + 1
                gradient = (sums[4:] + decayed * flat) / sums[2]
                first = 0.9 * first + 0.1 * gradient
                second = 0.999 * second + 0.001 * gradient**2
                rate = self.rate * np.sqrt(1.0 - 0.999**t) / (1.0 - 0.9**t)
                flat = flat - rate * first / (np.sqrt(second) + 1e-8)
            if not rows:
                raise ValueError("no complete row to train on")
            losses.append(loss / rows / 2)
            if waited >= self.patience:
                break
        if checks:
            score = rowsums.total(_batch(table, VALIDATION), lambda x, y, b, w=flat: step(x, y, b, w)[:2], scan=True)
            checks.append(score[1] / score[0])
        best = flat if not checks or checks[-1] < best_error else best
        return PerceptronModel(best, layers, names, losses, checks)
