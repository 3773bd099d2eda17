"""Spark ML's network of classes for tables whose gradients are worth packing their rows for.

The rows are written once as blocks, features by rows, and every gradient computes every row of them with matrix products in
numpy. Only sums of gradients come to the driver, which takes the steps of L-BFGS. Products and activations of a block are of
single precision, sums over blocks and steps of double; where training would end (but for the number of steps), all is computed
in double precision, and training goes on so if the two disagree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrain.operators import rowsums
from tunegrain.operators.descent import _unpack
from tunegrain.runtime import materialize

BLOCK_ROWS = 2048  # enough for numpy's calls to weigh little, few enough for a core's cache
MEMORY = 10  # last steps that a direction is made of
FLAT_STEPS = 20  # steps without a lower loss before training ends
SEARCH_TRIALS = 10


def blocks(train: DataFrame, features_col: str, label_col: str, width: int, classes: int) -> DataFrame:
    """(x, y): features of up to `BLOCK_ROWS` rows as doubles, value by value, and their labels as 32-bit integers.

    Rows are packed where they lie; their blocks are dealt to all cores.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column(0).null_count or batch.column(1).null_count:
                raise ValueError("a row without features or label")
            x, y = rowsums.matrix(batch.column(0)), rowsums.vector(batch.column(1))
            if x.shape[1] != width or not np.isfinite(x).all():
                raise ValueError(f"features that are not {width} finite values")
            if not ((y == np.floor(y)) & (y >= 0) & (y < classes)).all():
                raise ValueError(f"a label that is not a whole number below {classes}")
            parts = -(-len(y) // BLOCK_ROWS)
            values = [np.ascontiguousarray(p.T).tobytes() for p in np.array_split(x, parts)]
            labels = [p.tobytes() for p in np.array_split(y.astype(np.int32), parts)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(labels, pa.binary())], ["x", "y"])

    rows = train.select(rowsums.feature_array(train, features_col).alias("x"), F.col(label_col).cast("double").alias("y"))
    cores = train.sparkSession.sparkContext.defaultParallelism
    parts = -(-max(train.rdd.getNumPartitions(), 1) // cores) * cores
    return materialize(rows.mapInArrow(pack, "x binary, y binary").repartition(parts), "blocks")


class Kernel:
    """[rows, cross entropy, gradient...] summed over a block's rows; sigmoid layers, softmax on top.

    Weights of a layer lie by input, then output, its biases behind them, as in Spark ML. Room for activations is kept from
    block to block.
    """

    def __init__(self, flat: np.ndarray, layers: Sequence[int], kind: type = np.float64) -> None:
        self.steps = [(w.astype(kind), b.astype(kind)[:, None]) for w, b in _unpack(flat, layers)]
        self.kind, self.widest, self.room = kind, max(layers), {}

    def _room(self, use: object, width: int, n: int) -> np.ndarray:
        size = self.widest * n
        if use not in self.room or len(self.room[use]) < size:
            self.room[use] = np.empty(size, self.kind)
        return self.room[use][: width * n].reshape(width, n)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, last, at = len(y), len(self.steps) - 1, np.arange(len(y))
        values = [x.astype(self.kind, copy=False)]
        for i, (weight, bias) in enumerate(self.steps):
            z = self._room(i, weight.shape[1], n)
            np.matmul(weight.T, values[-1], out=z)
            z += bias
            if i < last:
                np.negative(z, out=z)
                with np.errstate(over="ignore"):
                    np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
            values.append(z)
        # The largest share counts apart: losses and slopes near nought keep their digits.
        z = values[-1]
        z -= z.max(axis=0)
        top = z.argmax(axis=0)
        own = z[y, at]
        delta = np.exp(z, out=z)
        delta[top, at] = 0
        others = delta.sum(axis=0)
        loss = float(np.log1p(others).sum(dtype=np.float64) - own.sum(dtype=np.float64))
        delta[top, at] = 1
        delta /= 1 + others
        delta[y, at] = 0
        delta[y, at] = -delta.sum(axis=0)
        parts: list[np.ndarray] = []
        for i in range(last, -1, -1):
            parts[:0] = [(delta @ values[i].T).T.ravel(), delta.sum(axis=1)]
            if i:
                weight, value = self.steps[i][0], values[i]
                back = self._room(("back", i % 2), len(value), n)
                np.matmul(weight, delta, out=back)
                back *= value
                np.subtract(1, value, out=value)
                back *= value
                delta = back
        return np.concatenate([[n, loss], *parts])


def mean_loss(table: DataFrame, layers: Sequence[int], flat: np.ndarray, kind: type = np.float64) -> tuple[float, np.ndarray]:
    """Mean cross entropy of all rows and its gradient."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        kernel = Kernel(flat, layers, kind)
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                labels = np.frombuffer(y.as_buffer(), np.int32)
                yield kernel(np.frombuffer(x.as_buffer()).reshape(-1, len(labels)), labels)

    sums = rowsums.total_of(table, fold, scan=True)
    return float(sums[1] / sums[0]), sums[2:] / sums[0]


class SearchFailed(ArithmeticError):
    """No step along a direction lowers the loss as it should."""


Objective = Callable[[np.ndarray, type], tuple[float, np.ndarray]]


def _direction(grad: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The last steps' estimate of minus the inverse Hessian times `grad`; `history` begins with the latest step."""
    out, shares = grad.copy(), []
    for step, change in history:
        shares.append(step @ out / (step @ change))
        out -= shares[-1] * change
    if history:
        out *= history[0][0] @ history[0][1] / (history[0][1] @ history[0][1])
    for (step, change), share in zip(reversed(history), reversed(shares)):
        out += (share - change @ out / (step @ change)) * step
    if not np.isfinite(out).all():
        raise SearchFailed("the last steps give no direction")
    return -out


def _search(
    objective: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, value: float, grad: np.ndarray, way: np.ndarray, length: float
) -> tuple[np.ndarray, float, np.ndarray]:
    """(x, value, gradient) at a step along `way` that meets the strong Wolfe conditions (1e-4 and 0.9)."""
    slope = float(grad @ way)
    if slope > 0:
        raise SearchFailed("the loss rises along the direction")

    def trial(t: float):
        at = x + t * way
        found, its = objective(at)
        return t, found, float(its @ way), at, its

    def between(a, b) -> float:
        """The least point of the cubic through both ends, away from either."""
        a, b = sorted((a, b), key=lambda e: e[0])
        first = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
        root = np.sqrt(max(first * first - a[2] * b[2], 0.0))
        t = b[0] - (b[0] - a[0]) * (b[2] + root - first) / (b[2] - a[2] + 2 * root)
        wide = b[0] - a[0]
        return float(np.clip(t if np.isfinite(t) else a[0] + wide / 2, a[0] + 0.1 * wide, a[0] + 0.9 * wide))

    def enough(e) -> bool:
        return e[1] <= value + 1e-4 * e[0] * slope

    def zoom(low, high):
        for _ in range(SEARCH_TRIALS):
            mid = trial(between(low, high))
            if not enough(mid) or mid[1] >= low[1]:
                high = mid
                continue
            if abs(mid[2]) <= 0.9 * abs(slope):
                return mid[3], mid[1], mid[4]
            if mid[2] * (high[0] - low[0]) >= 0:
                high = low
            low = mid
        raise SearchFailed("no step within the interval")

    low, t = (0.0, value, slope, x, grad), length
    for i in range(SEARCH_TRIALS):
        end = trial(t)
        if not np.isfinite(end[1]):
            t /= 2
        elif not enough(end) or (i and end[1] >= low[1]):
            return zoom(low, end)
        elif abs(end[2]) <= 0.9 * abs(slope):
            return end[3], end[1], end[4]
        elif end[2] >= 0:
            return zoom(end, low)
        else:
            low, t = end, t * 1.5
    raise SearchFailed("no step that is long enough")


def minimise(objective: Objective, x: np.ndarray, steps: int, tol: float) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with Spark ML's rules: the weights, and the losses after each step.

    It ends after `steps`, or when `FLAT_STEPS` of them lowered the loss by at most `tol` of the first loss, when the gradient is
    at most `tol` of the loss, or when two searches in a row fail. `objective` is asked in single precision until one of the last
    three holds, then in double: if the loss is another by more than `tol` of the first or the gradient by more than a tenth,
    steps go on in double precision until one holds again.
    """
    kind = np.float32
    value, grad = objective(x, kind)
    first, losses, recent, history, failed = value, [value], [value], [], 0
    while len(losses) <= steps:
        flat = len(recent) > FLAT_STEPS and max(recent[-FLAT_STEPS:]) - value <= tol * first
        if flat or failed == 2 or not np.linalg.norm(grad) > max(tol * value, 1e-8):
            if kind is np.float64:
                break
            kind = np.float64
            exact, exact_grad = objective(x, kind)
            agree = abs(exact - value) <= tol * first and np.linalg.norm(exact_grad - grad) <= max(0.1 * np.linalg.norm(exact_grad), 1e-8)
            value, grad = exact, exact_grad
            if agree:
                break
            recent, history, failed = [value], [], 0
            continue
        try:
            way = _direction(grad, history)
            length = 1.0 / float(np.linalg.norm(way)) if len(losses) == 1 else 1.0
            new, value_new, grad_new = _search(lambda at: objective(at, kind), x, value, grad, way, length)
        except SearchFailed:
            failed, history = failed + 1, []
            continue
        failed, history = 0, [(new - x, grad_new - grad), *history[: MEMORY - 1]]
        x, value, grad = new, value_new, grad_new
        losses.append(value)
        recent.append(value)
    return x, losses


class BlockPerceptronClassifier(MultilayerPerceptronClassifier):
    """The same network, start and steps, with every row of the same weight in a gradient.

    Spark ML's own trainer gives the weights to start from and, asked for no step at all, the model around the trained ones;
    that model's summary knows nothing of the training.
    """

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        if self.getSolver() != "l-bfgs":
            return super()._fit(dataset)
        layers = self.getLayers()
        names = self.getFeaturesCol(), self.getLabelCol()
        none = dataset.sparkSession.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], names)
        start = MultilayerPerceptronClassifier._fit(self.copy({self.maxIter: 0}), none).weights.toArray()
        table = blocks(dataset, *names, layers[0], layers[-1])
        best, _ = minimise(lambda flat, kind: mean_loss(table, layers, flat, kind), start, self.getMaxIter(), self.getTol())
        asked = self.copy({self.maxIter: 0, self.initialWeights: Vectors.dense(best)})
        return self._copyValues(self._create_model(asked._fit_java(none)))
