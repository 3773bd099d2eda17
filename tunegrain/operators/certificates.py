"""Checks that hold at the best model only, computed row by row from what was fitted."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunegrain.operators import rowsums

INTERCEPT = -1


def logistic_moments(model: LogisticRegressionModel, rows: DataFrame, reg: float, features_col: str = "features") -> DataFrame:
    """(class, feature, moment): mean of probability x feature, plus the penalty's share.

    Where the penalised loss has no slope, these are the means of feature x (1 if the row is of the class): the gradient is
    their difference. Feature -1 stands for the intercept, whose moments are the class shares. The penalty acts on standardised features, as
    in the trainer. Only classes x features sums come to the driver.
    """
    scored = model.transform(rows.select(features_col))
    classes, width = model.coefficientMatrix.numRows, model.coefficientMatrix.numCols
    both = F.concat(vector_to_array(F.col(model.getProbabilityCol())), rowsums.feature_array(scored, features_col))

    def fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        share, feature = x[:, :classes], x[:, classes:]
        return np.concatenate([[len(x)], share.sum(axis=0), (share.T @ feature).ravel(), feature.sum(axis=0), (feature**2).sum(axis=0)])

    sums = rowsums.total(scored.select(both.alias("x"), F.lit(0.0).alias("y")), fold)
    if sums is None:
        raise ValueError("no row to check")
    n = sums[0]
    share, products, first, second = np.split(sums[1:], np.cumsum([classes, classes * width, width]))
    variance = (second - first**2 / n) / (n - 1)
    moments = products.reshape(classes, width) / n + reg * variance * model.coefficientMatrix.toArray()
    out = [(k, INTERCEPT, float(share[k] / n)) for k in range(classes)]
    out += [(k, j, float(moments[k, j])) for k in range(classes) for j in range(width)]
    return rows.sparkSession.createDataFrame(out, "class int, feature int, moment double")


def best_splits(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, threshold, gain): for each feature the cut that lowers the label's variance most, with equal cuts the lowest.

    Rows are summed by feature and value first, prefix sums run over a feature's values; trees look at binned features,
    whose values are few. Cuts lie halfway between neighbouring values. Rows with a null feature or label do not count.
    """
    complete = rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y")).dropna()
    pairs = F.inline(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(features)]))
    # Squares are taken about the mean, or their sums would lose the digits that count.
    mean = complete.agg(F.avg("_y").alias("_mean"))
    centred = complete.join(F.broadcast(mean)).withColumn("_y", F.col("_y") - F.col("_mean"))
    sums = centred.select("_y", pairs).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q")
    )
    ordered = Window.partitionBy("feature").orderBy("value")
    whole = Window.partitionBy("feature")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = sums.select(
        "feature", ((F.col("value") + F.lead("value").over(ordered)) / 2).alias("threshold"),
        *[F.sum(c).over(running).alias(f"l{c}") for c in "nsq"], *[F.sum(c).over(whole).alias(f"t{c}") for c in "nsq"],
    ).filter("threshold is not null")

    def spread(n: str, s: str, q: str) -> str:
        return f"({q} - ({s}) * ({s}) / ({n}))"

    left, right = spread("ln", "ls", "lq"), spread("(tn - ln)", "(ts - ls)", "(tq - lq)")
    gain = F.expr(f"({spread('tn', 'ts', 'tq')} - {left} - {right}) / tn")
    best = cuts.select("feature", "threshold", gain.alias("gain"))
    return best.groupBy("feature").agg(F.max(F.struct("gain", (-F.col("threshold")).alias("down"))).alias("b")).select(
        "feature", (-F.col("b.down")).alias("threshold"), F.col("b.gain").alias("gain")
    )


def tree_roots(model) -> DataFrame:
    """(tree, feature, threshold, gain) of the first split of every tree of a fitted forest or boosting."""
    rows = []
    for number, tree in enumerate(model.trees):
        root = tree._call_java("rootNode")
        if root.subtreeDepth():
            split = root.split()
            rows.append((number, int(split.featureIndex()), float(split.threshold()), float(root.gain())))
    return SparkSession.active().createDataFrame(rows, "tree int, feature int, threshold double, gain double")
