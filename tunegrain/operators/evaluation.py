"""Model quality from a table of labels and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrain.runtime import materialize


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(rmse, mse, mae, r2) from one pass; r2 is null for a constant label."""
    error = F.col(label) - F.col(prediction)
    y = F.when(error.isNotNull(), F.col(label))
    mse = F.avg(error * error)
    return df.agg(
        F.sqrt(mse).alias("rmse"),
        mse.alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.try_divide(mse, F.var_pop(y))).alias("r2"),
    )


def exact_accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    same = F.col(label) == F.col(prediction)
    return df.agg(
        F.count_if(same).alias("exact"), F.count(F.lit(1)).alias("total"), F.avg(same.cast("int")).alias("accuracy")
    )


def _cells(df: DataFrame, label: str, prediction: str) -> DataFrame:
    pair = F.col(label).alias("label"), F.col(prediction).alias("prediction")
    return df.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return _cells(df, label, prediction).orderBy("label", "prediction")


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, precision, recall, f1, support) per class, from the confusion matrix.

    A class that is never predicted has precision 0, one that never occurs has recall 0.
    """
    cells = _cells(df, label, prediction)
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    as_label = F.struct(
        F.col("label"), n.alias("support"), zero.alias("predicted"),
        F.when(F.col("label") == F.col("prediction"), n).otherwise(zero).alias("correct"),
    )
    as_prediction = F.struct(
        F.col("prediction").alias("label"), zero.alias("support"), n.alias("predicted"), zero.alias("correct")
    )
    sums = (
        cells.select(F.inline(F.array(as_label, as_prediction)))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "correct")])
    )
    precision = F.coalesce(F.try_divide(F.col("correct"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("correct"), F.col("support")), F.lit(0.0))
    # The harmonic mean of both rates, written over the counts.
    f1 = F.coalesce(F.try_divide(2.0 * F.col("correct"), F.col("predicted") + F.col("support")), F.lit(0.0))
    return sums.select(
        "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(accuracy, precision, recall, f1), the last three weighted by class size."""
    report = class_report(df, label, prediction)
    total = F.sum("support")

    def weighted(rate: str):
        return (F.sum(F.col(rate) * F.col("support")) / total).alias(rate)

    # Weighted recall sums the correct rows of every class, which is the accuracy.
    return report.agg(
        weighted("recall").alias("accuracy"), weighted("precision"), weighted("recall"), weighted("f1")
    )


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy("n", label)


def n_classes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count_distinct(label).alias("n_classes"))


def majority_baseline(df: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy of always naming the largest class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("baseline_accuracy"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): total / (classes * size), so that every class weighs the same in sum."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    mean_size = counts.agg(F.avg("n")).scalar()
    return counts.withColumn("weight", mean_size / F.col("n"))


def with_class_weights(train: DataFrame, label: str = "label", to: DataFrame | None = None) -> DataFrame:
    """Adds `weight` as learnt from `train`; a class that `train` lacks gets weight 0."""
    weights = materialize(class_weights(train, label).select(label, "weight"), "weights")
    joined = (train if to is None else to).join(weights, label, "left")
    return joined.withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def error_histogram(
    df: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = 30
) -> DataFrame:
    """(bin, lo, hi, n): equal-width bins of label - prediction; the last bin includes its end.

    Errors that are null, NaN or infinite belong to no bin.
    """
    errors = df.select((F.col(label) - F.col(prediction)).cast("double").alias("e")).filter(
        F.col("e").isNotNull() & ~F.isnan("e") & (F.abs("e") < float("inf"))
    )
    lo, hi = errors.agg(F.min("e"), F.max("e")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint")
    width = (hi - lo) / bins or 1.0
    index = F.least(F.floor((F.col("e") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = errors.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
