from __future__ import annotations

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator

from tunegrain.operators import evaluation, features


@pytest.fixture(scope="module")
def regression(spark):
    return spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 6.0)], "label double, prediction double")


@pytest.fixture(scope="module")
def classes(spark):
    rows = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (2.0, 0.0)]
    return spark.createDataFrame(rows, "label double, prediction double")


def test_regression_metrics(regression):
    row = evaluation.regression_metrics(regression).first()
    assert (row.rmse, row.mse, row.mae, row.r2) == pytest.approx((1.0, 1.0, 0.5, 0.2))
    for name in ("rmse", "mse", "mae", "r2"):
        assert row[name] == pytest.approx(RegressionEvaluator(metricName=name).evaluate(regression))


def test_constant_label_has_no_r2(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert evaluation.regression_metrics(df).first().r2 is None


def test_classification_metrics(classes):
    row = evaluation.classification_metrics(classes).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == pytest.approx((0.6, 0.466667, 0.6, 0.52), abs=1e-6)
    for name, metric in (("accuracy", "accuracy"), ("precision", "weightedPrecision"),
                         ("recall", "weightedRecall"), ("f1", "f1")):
        assert row[name] == pytest.approx(MulticlassClassificationEvaluator(metricName=metric).evaluate(classes))


def test_report_and_distribution(classes):
    report = {r.label: r for r in evaluation.class_report(classes).collect()}
    assert (report[2.0].precision, report[2.0].recall, report[2.0].f1, report[2.0].support) == (0.0, 0.0, 0.0, 1)
    assert report[1.0].precision == pytest.approx(2 / 3)
    assert [tuple(r) for r in evaluation.class_distribution(classes).collect()] == [(2.0, 1), (0.0, 2), (1.0, 2)]
    assert evaluation.majority_baseline(classes).first()[0] == pytest.approx(0.4)
    assert evaluation.n_classes(classes).first()[0] == 3
    assert [tuple(r) for r in evaluation.confusion_matrix(classes).collect()] == [
        (0.0, 0.0, 1), (0.0, 1.0, 1), (1.0, 1.0, 2), (2.0, 0.0, 1)
    ]


def test_weights_of_unknown_classes(spark, classes):
    test = spark.createDataFrame([(0.0,), (9.0,)], "label double")
    rows = dict(map(tuple, evaluation.with_class_weights(classes, to=test).collect()))
    assert rows == {0.0: pytest.approx(5 / 6), 9.0: 0.0}


def test_error_histogram(spark, regression):
    rows = evaluation.error_histogram(regression, bins=4).orderBy("bin").collect()
    assert [r.n for r in rows] == [1, 0, 0, 3] and (rows[0].lo, rows[3].hi) == (-2.0, 0.0)
    same = spark.createDataFrame([(1.0, 1.0)] * 3, "label double, prediction double")
    assert sum(r.n for r in evaluation.error_histogram(same).collect()) == 3
    assert evaluation.error_histogram(regression.limit(0)).count() == 0


def test_class_index(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string")
    assert sorted(map(tuple, features.class_index(df, "c").collect())) == [("a", 0), ("b", 1)]
    assert features.with_class_index(df, "c").count() == 3


def test_error_histogram_leaves_out_what_is_no_number(spark):
    rows = [(1.0, 0.0), (2.0, 0.0), (1.0, float("nan")), (None, 1.0), (float("inf"), 1.0)]
    bins = evaluation.error_histogram(spark.createDataFrame(rows, "label double, prediction double"), bins=2).orderBy("bin").collect()
    assert [(r.lo, r.hi, r.n) for r in bins] == [(1.0, 1.5, 1), (1.5, 2.0, 1)]
