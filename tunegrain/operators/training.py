"""Trainers of Spark ML models with the settings of each release-year experiment.

Every function takes a training table with a vector column and a label and returns a fitted
model. Any estimator parameter can be overridden by keyword.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from math import prod
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.regression import (
    FMRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.functions import years
from tunegrain.operators import features, rowsums
from tunegrain.operators.network import BlockPerceptronClassifier
from tunegrain.runtime import materialize, new_folder

SEED = 42
FOREST_NODES = 200_000  # nodes of trees that the driver holds at once, about
SENT_NODES = 5_000  # nodes of trees that go out with every step of a forest rather than being kept by row
FOREST_ROWS = 500_000  # rows of a partition, whose sums of every node weigh more than fewer rows
PART_SEEDS = 1_000_003  # Spark adds the number of a partition to a forest's seed, so parts' seeds lie far apart
CELL_FEATURES = 20  # more features than that have too many cells; their rows are not looked at for it
BAG_BYTES = 32 * 1024 * 1024  # counts of trees that a partition of a forest's rows holds, about


def _columns(features_col: str, label_col: str, overrides: dict[str, Any]) -> dict[str, Any]:
    return {"featuresCol": features_col, "labelCol": label_col, **overrides}


def spread(train: DataFrame, trees: int, bag_bytes: int = BAG_BYTES) -> DataFrame:
    """`train` in enough partitions for a forest, which keeps a count of every tree beside each row.

    Those counts outweigh the row by far, so the partitions of a small file would be too large. Small tables stay as they are.
    """
    wanted = -(-train.count() * trees * 4 // bag_bytes)
    return train.repartition(max(wanted, train.sparkSession.sparkContext.defaultParallelism)) if wanted > 1 else train


# --- regression ---------------------------------------------------------------------------


def fit_linear(train: DataFrame, features_col: str = "features", label_col: str = "label", **params: Any) -> Model:
    return LinearRegression(**_columns(features_col, label_col, params)).fit(train)


def fit_linear_poly(
    train: DataFrame, features_col: str = "features", label_col: str = "label", degree: int = 2, **params: Any
) -> PipelineModel:
    """Robust scaling, polynomial terms, then least squares by l-bfgs.

    Two degrees of 90 features give 4,185 columns, more than the normal-equation solver takes.
    """
    settings = {"solver": "l-bfgs", "maxIter": 400, "tol": 1e-6, **params}
    return features.chain(
        features.robust_scaler(features_col, "_robust"),
        features.polynomial("_robust", "_poly", degree),
        LinearRegression(**_columns("_poly", label_col, settings)),
    ).fit(train)


def fit_glm(train: DataFrame, features_col: str = "features", label_col: str = "label", **params: Any) -> Model:
    settings = {"family": "gaussian", "link": "identity", **params}
    return GeneralizedLinearRegression(**_columns(features_col, label_col, settings)).fit(train)


def fit_forest(train: DataFrame, features_col: str = "features", label_col: str = "label", **params: Any) -> Model:
    return RandomForestRegressor(**_columns(features_col, label_col, {"seed": SEED, **params})).fit(train)


def fit_boosted_trees(
    train: DataFrame, features_col: str = "features", label_col: str = "label", **params: Any
) -> Model:
    return GBTRegressor(**_columns(features_col, label_col, {"seed": SEED, **params})).fit(train)


def bin_cuts(train: DataFrame, features_col: str, label_col: str, bins: int) -> tuple[list[np.ndarray], int] | None:
    """Cuts between the bins of each feature, and the rows: halfway between its values if those are at most `bins`, else its quantiles.

    None if a row has no finite feature or label, or if there are too many features. One pass keeps `bins` values and one more
    of each feature; only features with more values need another for the quantiles.
    """
    rows = train.select(rowsums.feature_array(train, features_col).alias("x"), F.col(label_col).cast("double").alias("y"))
    first = rows.first()
    if first is None or first["x"] is None or not 0 < len(first["x"]) <= CELL_FEATURES:
        return None
    width = len(first["x"])

    def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, count, gaps = [np.empty(0)] * width, 0, 0
        for batch in batches:
            x, y = batch.column(0), batch.column(1)
            count += len(y)
            if x.null_count or y.null_count or x.flatten().null_count:
                gaps += 1
                continue
            x = rowsums.matrix(x)
            gaps += not (np.isfinite(x).all() and np.isfinite(rowsums.vector(y)).all())
            for j in range(width):
                if len(values[j]) <= bins:
                    values[j] = np.union1d(values[j], x[:, j])[: bins + 1]
        found = [(j, v, 0) for j in range(width) for v in values[j].tolist()] + [(-1, None, count), (-2, None, gaps)]
        yield pa.RecordBatch.from_pylist([{"j": j, "v": v, "n": n} for j, v, n in found], pa.schema([("j", pa.int32()), ("v", pa.float64()), ("n", pa.int64())]))

    found = rows.mapInArrow(seen, "j int, v double, n long").groupBy("j", "v").agg(F.sum("n").alias("n"))
    # of each feature one value more than bins tells that it has too many
    kept = found.groupBy("j").agg(F.slice(F.sort_array(F.collect_list("v")), 1, bins + 1).alias("v"), F.sum("n").alias("n"))
    parts = {r["j"]: r for r in kept.collect()}
    if parts[-2]["n"]:
        return None
    cuts = [(np.array(parts[j]["v"][:-1]) + np.array(parts[j]["v"][1:])) / 2 for j in range(width)]
    many = [j for j in range(width) if len(cuts[j]) >= bins]
    if many and prod(len(c) + 1 if j not in many else bins for j, c in enumerate(cuts)) * 2 <= parts[-1]["n"]:
        columns = rows.select(*[F.get("x", F.lit(j)).alias(f"x{j}") for j in many])
        shares = [i / bins for i in range(1, bins)]
        for j, at in zip(many, columns.approxQuantile(columns.columns, shares, 0.001)):
            cuts[j] = np.unique(at)
    return cuts, parts[-1]["n"]


class CellModel(Model):
    """Trees over the numbers of the bins that a row's features lie in."""

    def __init__(self, model: Model, cuts: list[np.ndarray]) -> None:
        super().__init__()
        self.model, self.cuts = model, cuts

    def _transform(self, dataset: DataFrame) -> DataFrame:
        source = self.model.getFeaturesCol()
        model = self.model.copy({self.model.featuresCol: "_cell"})
        return model.transform(dataset.withColumn("_cell", features.as_vector(in_bins(dataset, source, self.cuts)))).drop("_cell")


def in_bins(df: DataFrame, features_col: str, cuts: list[np.ndarray]) -> Column:
    """The number of each feature's bin, as an array of doubles; a value on a cut lies below it."""

    @F.arrow_udf("array<double>")
    def numbers(values: pa.Array) -> pa.Array:
        x = rowsums.matrix(values) if len(values) else np.empty((0, len(cuts)))
        found = np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]).astype(float)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(cuts), pa.int32()), pa.array(found.ravel()))

    return numbers(rowsums.feature_array(df, features_col))


class CellBoosting(Estimator):
    """Boosting of squared error that reads the rows of few features once, not in every round.

    Trees see only the bins of the features, so all rows of a cell (one bin of each feature) get the same predictions in every
    round, and the best cuts follow from the cells' counts and mean labels: the spread within a cell is the same on both sides
    of any cut's gain. Rounds run over the cells, of which there are at most `maxBins` to the power of the features. Where
    that is not under half the rows, or a row has a gap, boosting runs over the rows.
    """

    def __init__(self, trees: GBTRegressor) -> None:
        super().__init__()
        self.trees = trees

    def _fit(self, dataset: DataFrame) -> Model:
        trees = self.trees
        source, label = trees.getFeaturesCol(), trees.getLabelCol()
        plain = trees.getLossType() == "squared" and trees.getSubsamplingRate() == 1.0 and trees.getMinInstancesPerNode() == 1
        plain = plain and not any(trees.isDefined(p) for p in (trees.weightCol, trees.validationIndicatorCol))
        found = bin_cuts(dataset, source, label, trees.getMaxBins()) if plain else None
        if found is None or prod(len(c) + 1 for c in found[0]) * 2 > found[1]:
            return trees.fit(dataset)
        cell = in_bins(dataset, source, found[0])
        cells = dataset.select(cell.alias("_cell"), F.col(label).cast("double").alias("_y")).groupBy("_cell").agg(
            F.avg("_y").alias(label), F.count(F.lit(1)).cast("double").alias("_rows")
        )
        cells = materialize(cells, "cells").select(features.as_vector("_cell").alias(source), label, "_rows")
        return CellModel(trees.copy({trees.weightCol: "_rows"}).fit(cells), found[0])


def boosted_trees_long(features_col: str = "features", label_col: str = "label", **params: Any) -> CellBoosting:
    """The longer boosting run: 100 rounds of depth 5."""
    settings = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "seed": SEED, **params}
    return CellBoosting(GBTRegressor(**_columns(features_col, label_col, settings)))


def factorization_machine(features_col: str = "features", label_col: str = "label", **params: Any) -> FMRegressor:
    settings = {
        "factorSize": 4, "solver": "adamW", "miniBatchFraction": 0.2, "maxIter": 400, "stepSize": 0.05,
        "regParam": 0.01, "seed": SEED, **params,
    }
    return FMRegressor(**_columns(features_col, label_col, settings))


# --- classification -----------------------------------------------------------------------


def _indexed(train: DataFrame, label_col: str, classifier: Estimator) -> PipelineModel:
    """Index the label first: raw years would make a class of every integer up to the largest year.

    Rows without a label teach nothing and are left out.
    """
    label = F.col(label_col)
    train = train.filter(label.isNotNull() & ~F.isnan(label.cast("double")) if dict(train.dtypes)[label_col] in ("double", "float") else label.isNotNull())
    indexer = StringIndexer(inputCol=label_col, outputCol="_class", stringOrderType="alphabetAsc").fit(train)
    fitted = classifier.fit(indexer.transform(train))
    names = IndexToString(inputCol="_prediction", outputCol="prediction", labels=indexer.labels)
    return PipelineModel([fitted, names])


def fit_logistic(
    train: DataFrame, features_col: str = "features", label_col: str = "label", **params: Any
) -> PipelineModel:
    """Multinomial with an L2 penalty; `prediction` is the original label as text."""
    settings = {"maxIter": 100, "regParam": 0.01, "elasticNetParam": 0.0, "family": "multinomial", **params}
    classifier = LogisticRegression(featuresCol=features_col, labelCol="_class", predictionCol="_prediction", **settings)
    return _indexed(train, label_col, classifier)


class ForestParts(Model):
    """A forest of classes whose trees lie in the shared folder, in parts of about `FOREST_NODES` nodes.

    Scoring loads one part after the other and writes the rows with the votes up to it, so neither driver nor executors hold more than a part.
    Columns are those of Spark ML's forest.
    """

    def __init__(self, paths: list[str], trees: list[int], nodes: list[int], names: tuple[str, str, str]) -> None:
        super().__init__()
        self.paths, self.trees, self.nodes, self.names = paths, trees, nodes, names

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows, names = dataset, ["_raw", "_share", "_class"]
        for path in self.paths:
            part = RandomForestClassificationModel.load(path)
            part = part.setRawPredictionCol(names[0]).setProbabilityCol(names[1]).setPredictionCol(names[2])
            votes = features.vector_to_array("_raw")
            if "_votes" in rows.columns:
                votes = F.zip_with("_votes", votes, lambda a, b: a + b)
            rows = materialize(part.transform(rows).withColumn("_votes", votes).drop(*names), "votes")
        first = F.array_position("_votes", F.array_max("_votes")) - 1
        whole = F.aggregate("_votes", F.lit(0.0), lambda a, b: a + b)
        share = F.transform("_votes", lambda v: F.coalesce(F.try_divide(v, whole), F.lit(0.0)))
        return rows.select(
            *dataset.columns, features.as_vector(F.col("_votes")).alias(self.names[0]),
            features.as_vector(share).alias(self.names[1]), first.cast("double").alias(self.names[2]),
        )


def _fit_in_parts(forest: RandomForestClassifier, train: DataFrame, forest_nodes: int) -> ForestParts:
    """The trees of `forest` in several runs of its trainer with seeds of their own, two trees in the first.

    Later runs, some at once, have as many trees as fit `forest_nodes` together, by the nodes of the first. Each task of a run sums
    every node up, so a run has no more partitions than its rows need. It has two trees at least: one alone would get its rows
    without repeats.
    """
    train, left = materialize(train, "train"), forest.getNumTrees()
    rows, cores, read = train.count(), train.sparkSession.sparkContext.defaultParallelism, train.rdd.getNumPartitions()
    paths, trees, nodes = [], [], []

    def partitions(some: int) -> int:
        return max(1, -(-rows * some * 4 // BAG_BYTES), rows // FOREST_ROWS)

    def run(number: int, some: int) -> tuple[str, int]:
        dealt = train.repartition(partitions(some)) if partitions(some) > read else train.coalesce(partitions(some))
        # the trainer sends its trees with every step, or keeps the node of every row and tree
        many = not nodes or some * sum(nodes) > SENT_NODES * sum(trees)
        model = forest.copy({forest.numTrees: some, forest.seed: forest.getSeed() + PART_SEEDS * number, forest.cacheNodeIds: many}).fit(dealt)
        path = new_folder(train.sparkSession, "forest")
        model.write().save(path)
        return path, model.totalNumNodes

    def parts(count: int, some: int) -> list[int]:
        """`count` trees in runs of `some`, the last with one more instead of one alone."""
        whole = [some] * (count // some) + [count % some] * (count % some > 0)
        return [*whole[:-2], whole[-2] + 1] if len(whole) > 1 and whole[-1] == 1 else whole

    sizes, at_once = [2], 1
    while left:
        calls = [inheritable_thread_target(train.sparkSession)(partial(run, len(paths) + i, some)) for i, some in enumerate(sizes)]
        with ThreadPool(at_once) as pool:
            found = pool.map(lambda call: call(), calls, 1)
        for (path, count), some in zip(found, sizes):
            paths.append(path)
            trees.append(some)
            nodes.append(count)
        left = forest.getNumTrees() - sum(trees)
        most = max(2, min(left, forest_nodes * sum(trees) // sum(nodes)))
        # runs over few partitions share the cores, a large table takes them all for one
        at_once = max(1, cores // partitions(2)) if partitions(most) < cores else 1
        some = max(2, min(-(-left // at_once), most // at_once))
        at_once = max(1, min(at_once, most // some))
        sizes = parts(left, some)
    return ForestParts(paths, trees, nodes, (forest.getRawPredictionCol(), forest.getProbabilityCol(), forest.getPredictionCol()))


def fit_forest_classifier(
    train: DataFrame, features_col: str = "features", label_col: str = "label", weight_col: str | None = "weight",
    forest_nodes: int = FOREST_NODES, **params: Any,
) -> Model:
    """Weighted random forest over dense class labels.

    Its trainer keeps all trees on the driver and sends them with every step, so a forest that could have more than
    `forest_nodes` nodes is fitted and scored in parts.
    """
    settings = {
        "numTrees": 300, "maxDepth": 15, "minInstancesPerNode": 5, "subsamplingRate": 0.7, "seed": SEED, **params,
    }
    if weight_col:
        settings["weightCol"] = weight_col
    forest = RandomForestClassifier(**_columns(features_col, label_col, settings))
    dealt = spread(train, settings["numTrees"])
    leaves = min(2.0 ** forest.getMaxDepth(), train.count() * forest.getSubsamplingRate() / forest.getMinInstancesPerNode())
    within = 2 * leaves * forest.getNumTrees() <= forest_nodes or forest.getNumTrees() < 4
    if within or forest.isSet(forest.thresholds) or forest.getLeafCol():
        return forest.fit(dealt)
    return _fit_in_parts(forest, dealt, forest_nodes)


def fit_perceptron_classifier(
    train: DataFrame, classes: int, width: int, features_col: str = "features", label_col: str = "label",
    hidden: tuple[int, ...] = (64, 32), **params: Any,
) -> Model:
    """Feed-forward network over dense class labels; a table that is dealt out anew trains over packed blocks of its rows."""
    settings = {
        "layers": [width, *hidden, classes], "solver": "l-bfgs", "blockSize": 1024, "maxIter": 200, "tol": 1e-6,
        "seed": SEED, **params,
    }
    # blocks hold width + classes doubles of a row, as much as the counts of twice as many trees
    dealt = spread(train, 2 * (width + classes))
    if dealt is train:
        return MultilayerPerceptronClassifier(**_columns(features_col, label_col, settings)).fit(train)
    # the packed blocks are dealt out; rows only where a few tasks would pack them
    enough = train.rdd.getNumPartitions() >= train.sparkSession.sparkContext.defaultParallelism
    return BlockPerceptronClassifier(**_columns(features_col, label_col, settings)).fit(train if enough else dealt)


# --- range-constrained regression -----------------------------------------------------------


class YearModel:
    """A fitted regressor of the scaled year whose predictions are years within [lo, hi]."""

    def __init__(self, model: Model, lo: float, hi: float) -> None:
        self.model, self.lo, self.hi = model, lo, hi

    def transform(self, df: DataFrame, as_float: bool = False) -> DataFrame:
        year = years.clip(years.unscale(F.col("prediction"), self.lo, self.hi), self.lo, self.hi)
        predicted = self.model.transform(df)
        return predicted.withColumn("prediction", year if as_float else years.to_year(year))


def fit_year_model(
    train: DataFrame, regressor: Estimator | Pipeline, year_col: str = "year", lo: float = years.YEAR_LO,
    hi: float = years.YEAR_HI, scaled_col: str = "label",
) -> YearModel:
    """Fit any regressor whose label column is `scaled_col` on the year scaled by lo and hi."""
    scaled = train.withColumn(scaled_col, years.scale(F.col(year_col), lo, hi))
    return YearModel(regressor.fit(scaled), lo, hi)
