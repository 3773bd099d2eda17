"""Feature vectors: assembling, scaling, PCA, polynomial terms, label indexes, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (
    PCA, IndexToString, MinMaxScaler, PCAModel, PolynomialExpansion, RobustScaler, StandardScaler, StringIndexer,
    StringIndexerModel, VectorAssembler, VectorSlicer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.operators.quantiles import exact_percentiles
from tunegrain.operators.ranking import with_rank
from tunegrain.runtime import broadcast_within, materialize


def assemble(cols: Sequence[str], output_col: str = "features", on_invalid: str = "error") -> VectorAssembler:
    """Numeric and vector columns into one vector; `on_invalid` is "error", "skip" or "keep"."""
    return VectorAssembler(inputCols=list(cols), outputCol=output_col, handleInvalid=on_invalid)


def as_vector(col: str | Column) -> Column:
    return array_to_vector(F.col(col).cast("array<double>") if isinstance(col, str) else col)


def standard_scaler(input_col: str, output_col: str, with_mean: bool = True) -> StandardScaler:
    return StandardScaler(inputCol=input_col, outputCol=output_col, withMean=with_mean, withStd=True)


def minmax_scaler(input_col: str, output_col: str) -> MinMaxScaler:
    return MinMaxScaler(inputCol=input_col, outputCol=output_col)


def robust_scaler(input_col: str, output_col: str, relative_error: float = 0.001) -> RobustScaler:
    """Median and quartile range from a quantile sketch; `robust_scaled` is the exact form."""
    return RobustScaler(
        inputCol=input_col, outputCol=output_col, withCentering=True, withScaling=True, relativeError=relative_error
    )


def polynomial(input_col: str, output_col: str, degree: int = 2) -> PolynomialExpansion:
    return PolynomialExpansion(inputCol=input_col, outputCol=output_col, degree=degree)


def pca(input_col: str, output_col: str, k: int) -> PCA:
    return PCA(inputCol=input_col, outputCol=output_col, k=k)


def label_indexer(input_col: str, output_col: str = "label", by: str = "frequency") -> StringIndexer:
    """Dense labels by falling frequency (ties alphabetical) or in alphabetical order."""
    order = {"frequency": "frequencyDesc", "alphabet": "alphabetAsc"}[by]
    return StringIndexer(inputCol=input_col, outputCol=output_col, stringOrderType=order)


def label_names(model: StringIndexerModel, input_col: str, output_col: str) -> IndexToString:
    return IndexToString(inputCol=input_col, outputCol=output_col, labels=model.labels)


def chain(*stages: Estimator | Transformer) -> Pipeline:
    return Pipeline(stages=list(stages))


def vector_columns(df: DataFrame, vector: str, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Spread a vector over named columns."""
    values = vector_to_array(F.col(vector))
    spread = df.select(*keep, values.alias("_values"))
    return spread.select(*keep, *[F.get("_values", F.lit(i)).alias(name) for i, name in enumerate(names)])


def robust_scaled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - median) / (q3 - q1) with exact, interpolated quartiles; a zero range only centres."""
    found = {(r["column"], r["prob"]): r["value"] for r in exact_percentiles(df, cols, [0.25, 0.5, 0.75]).collect()}
    scaled = []
    for c in cols:
        q1, median, q3 = (found[(c, p)] for p in (0.25, 0.5, 0.75))
        if median is None:
            scaled.append(F.lit(None).cast("double").alias(c))
        else:
            scaled.append(((F.col(c) - F.lit(median)) / F.lit((q3 - q1) or 1.0)).alias(c))
    return df.select(*[c for c in df.columns if c not in cols], *scaled)


def scale_label(df: DataFrame, col: str) -> tuple[DataFrame, tuple[float, float]]:
    """Z-score of the label, and the (mean, deviation) needed to undo it."""
    mean, std = df.agg(F.avg(col), F.stddev_samp(col)).first()
    return df.withColumn(col, (F.col(col) - F.lit(mean)) / F.lit(std)), (mean, std)


def unscale_label(df: DataFrame, cols: Sequence[str], stats: tuple[float, float]) -> DataFrame:
    mean, std = stats
    return df.withColumns({c: F.col(c) * F.lit(std) + F.lit(mean) for c in cols})


# --- principal components ----------------------------------------------------------------


def explained_variance(df: DataFrame, model: PCAModel) -> DataFrame:
    """(component, explained, cumulative), one row per fitted component."""
    rows, total = [], 0.0
    for i, share in enumerate(model.explainedVariance.toArray(), 1):
        total += float(share)
        rows.append((i, float(share), total))
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")


def components_needed(model: PCAModel, threshold: float) -> int:
    """Fewest components that reach `threshold`; all of them if it is never reached."""
    total = 0.0
    shares = model.explainedVariance.toArray()
    for i, share in enumerate(shares, 1):
        total += float(share)
        if total >= threshold:
            return i
    return len(shares)


def leading_components(model: PCAModel, k: int, output_col: str) -> VectorSlicer:
    """The first k components of a fitted PCA are the PCA of size k, so nothing is fitted again."""
    return VectorSlicer(inputCol=model.getOutputCol(), outputCol=output_col, indices=list(range(k)))


def fit_reduction(
    df: DataFrame, input_col: str, output_col: str, threshold: float = 0.9, max_k: int | None = None
) -> tuple[PipelineModel, int]:
    """PCA cut to the fewest components that explain `threshold` of the variance.

    All components are looked at unless `max_k` says less; if those do not reach the threshold, that is an error.
    """
    width = len(df.select(vector_to_array(F.col(input_col)).alias("v")).first()["v"])
    size = min(max_k or width, width)
    model = pca(input_col, f"_{output_col}_all", size).fit(df)
    k = components_needed(model, threshold)
    reached = float(sum(model.explainedVariance.toArray()[:k]))
    if size < width and reached < threshold:
        raise ValueError(f"{size} components explain {reached:.4f} of the variance, less than {threshold}")
    return PipelineModel([model, leading_components(model, k, output_col)]), k


# --- classes ------------------------------------------------------------------------------


def class_index(df: DataFrame, col: str) -> DataFrame:
    """(col, label): dense 0-based labels in ascending order of the distinct values, however many there are."""
    classes = df.select(col).filter(F.col(col).isNotNull()).distinct()
    return with_rank(classes, [col], "label").select(col, F.col("label").cast("int"))


def with_class_index(df: DataFrame, col: str) -> DataFrame:
    """Adds `label`; rows without a class are left out. Few classes are broadcast, many are joined by shuffle."""
    index = materialize(class_index(df, col), "classes")
    return df.join(broadcast_within(index, index.count()), col)


def unseen_classes(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    return test.select(col).distinct().subtract(train.select(col).distinct())


# --- correlation --------------------------------------------------------------------------


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, i, j, r): Pearson coefficients of every ordered pair of columns.

    Only the columns x columns matrix reaches the driver.
    """
    vectors = assemble(cols, "_features", on_invalid="skip").transform(df.select(*cols)).select("_features")
    matrix = Correlation.corr(vectors, "_features", "pearson").first()[0].toArray()
    rows = [
        (a, b, i, j, float(matrix[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, i int, j int, r double")


def weak_pairs(matrix: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(weak, pairs, share): unordered pairs with |r| below the threshold."""
    pairs = matrix.filter(F.col("i") < F.col("j"))
    weak = F.count_if(F.abs("r") < threshold)
    return pairs.agg(
        weak.alias("weak"), F.count(F.lit(1)).alias("pairs"), (weak / F.count(F.lit(1))).alias("share")
    )


def wide_matrix(matrix: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column name, one column per column name."""
    return (
        matrix.groupBy("a", "i").pivot("b", list(cols)).agg(F.first("r")).orderBy("i").drop("i")
        .withColumnRenamed("a", "feature")
    )


def column_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("r"))
