from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tunegrain.operators import descent, evaluation, features, network, ridge, sampling, training
from tunegrain.plans import year_prediction


@pytest.fixture(scope="module")
def data():
    random = np.random.default_rng(5)
    x = random.normal(size=(400, 4)) * [1, 2, 3, 0.5] + [0, 5, -2, 1]
    y = x @ [2.0, -1.0, 0.5, 3.0] + 7 + random.normal(size=400) * 0.3
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "id long, x array<double>, label double")
    return df.select("id", features.as_vector("x").alias("features"), "label").cache()


def ridge_by_hand(x, y, penalty):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    inverse = np.linalg.inv(xc.T @ xc + penalty * np.eye(x.shape[1]))
    return xc, yc, inverse, inverse @ xc.T @ yc


def test_ridge_and_leave_one_out(data, rows):
    x, y = data
    model = ridge.fit_ridge(rows, alpha=0.01)
    xc, yc, inverse, weights = ridge_by_hand(x, y, 0.01 * len(y))
    assert model.weights == pytest.approx(weights)
    hat = np.diag(xc @ inverse @ xc.T)
    expected = np.mean(((yc - xc @ weights) / (1 - hat)) ** 2)
    assert ridge.leave_one_out(rows, model).first().loocv_mse == pytest.approx(expected)
    predicted = np.array([r.prediction for r in model.transform(rows).orderBy("id").collect()])
    assert predicted == pytest.approx(xc @ weights + y.mean())


def test_ridge_agrees_with_spark(data, rows):
    x, y = data
    ours = ridge.fit_ridge(rows, alpha=1.0, per_row=False).weights
    # Spark divides the penalty by the label's deviation.
    spark_model = LinearRegression(
        solver="l-bfgs", standardization=False, regParam=float(y.std(ddof=1) / len(y)), tol=1e-12, maxIter=500
    ).fit(rows)
    assert ours == pytest.approx(spark_model.coefficients.toArray(), rel=1e-4)


def test_sgd_reaches_least_squares_whatever_the_layout(rows):
    scaled = features.standard_scaler("features", "z").fit(rows).transform(rows)
    centred, _ = features.scale_label(scaled, "label")
    make = lambda: descent.SGDRegressor(key="id", features_col="z", steps=24, step=0.5, batch_fraction=0.25)
    model = make().fit(centred)
    other = make().fit(centred.repartition(5))
    assert model.weights == pytest.approx(other.weights)
    exact = LinearRegression(featuresCol="z").fit(centred).coefficients.toArray()
    assert model.weights == pytest.approx(exact, abs=0.08)
    assert evaluation.regression_metrics(model.transform(centred)).first().r2 > 0.95


def test_perceptron_gradient_is_the_slope_of_the_loss():
    random = np.random.default_rng(0)
    layers = [3, 4, 2, 1]
    size = sum(a * b + b for a, b in zip(layers, layers[1:]))
    x, y, flat = random.normal(size=(20, 3)), random.normal(size=20), random.normal(size=size)
    gradient = descent._loss_gradient(x, y, flat, layers)[2:]
    for i in range(size):
        step = np.zeros(size)
        step[i] = 1e-6
        up, down = (descent._loss_gradient(x, y, flat + s, layers)[1] / 2 for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-4)


def test_perceptron_beats_the_mean_within_its_range(rows):
    scaled = features.standard_scaler("features", "z").fit(rows).transform(rows)
    regressor = descent.PerceptronRegressor(
        key="id", features_col="z", label_col="unit", hidden=(8,), epochs=40, rate=0.05, patience=20
    )
    model = training.fit_year_model(scaled, regressor, "label", -20, 20, "unit")
    assert len(model.model.losses) >= 5 and model.model.losses[-1] < model.model.losses[0]
    as_float = model.transform(scaled, as_float=True)
    assert evaluation.regression_metrics(as_float).first().r2 > 0.7
    low, high = model.transform(scaled).agg(F.min("prediction"), F.max("prediction")).first()
    assert isinstance(low, int) and -20 <= low <= high <= 20


def test_spark_regressors_beat_the_mean(rows):
    train, test = sampling.split(rows, "id")
    models = [
        training.fit_linear(train), training.fit_glm(train), training.fit_forest(train),
        training.fit_boosted_trees(train, maxIter=5), training.fit_linear_poly(train, maxIter=60),
    ]
    for model in models:
        assert evaluation.regression_metrics(model.transform(test)).first().r2 > 0.4


def test_classifiers_beat_the_majority(rows):
    labelled = rows.withColumn("year", F.when(F.col("label") > 2, 1999).otherwise(1970))
    train, test = sampling.split(labelled, "id")
    baseline = evaluation.majority_baseline(test, "year").first()[0]
    logistic = training.fit_logistic(train, label_col="year").transform(test)
    logistic = logistic.withColumn("prediction", F.col("prediction").cast("int"))
    assert evaluation.classification_metrics(logistic, "year").first().accuracy > baseline


def test_reduction_slices_one_fit(rows):
    scaled = features.standard_scaler("features", "z").fit(rows).transform(rows)
    model, k = features.fit_reduction(scaled, "z", "p", 0.6)
    refit = features.pca("z", "q", k).fit(scaled)
    both = refit.transform(model.transform(scaled)).select(vector_to_array("p").alias("p"), vector_to_array("q").alias("q"))
    for r in both.collect():
        assert np.abs(r.p) == pytest.approx(np.abs(r.q))
    full = features.pca("z", "c", 4).fit(scaled)
    table = features.explained_variance(scaled, full).collect()
    assert table[-1].cumulative == pytest.approx(1.0) and features.components_needed(full, 2.0) == 4


@pytest.fixture(scope="module")
def corpus(spark):
    """Songs whose signature carries the decade; one has a gap, one no year."""
    random = np.random.default_rng(8)
    out = []
    for i in range(240):
        year = 1960 + (i * 7) % 50
        signature = (random.normal(size=90) * 0.2 + (year - 1985) / 25.0).tolist()
        if i == 0:
            signature[3] = None
        out.append((f"s{i}", signature, signature, 0 if i == 1 else year, float(year), 1.0, 5))
    return spark.createDataFrame(
        out, "song_id string, segments_timbre array<double>, segments_pitches array<double>, year int, "
             "loudness double, danceability double, artist_7digitalid int"
    )


def test_year_prediction(corpus):
    table = year_prediction.signature_features(corpus)
    assert table.count() == 238
    balance = lambda df: sampling.balance_bins(df, "year", "song_id", 1960, 2010, n=30)
    report = year_prediction.predict_years(table, LinearRegression(regParam=0.1), balance=balance, lo=1960, hi=2010)
    assert report.metrics.first().r2 > 0.8
    assert report.accuracy.first().total == report.predictions.count()
    train, test = sampling.split(table, "song_id")
    assert {r.song_id for r in report.predictions.collect()} == {r.song_id for r in test.collect()}
    leaky = year_prediction.predict_years(table, LinearRegression(regParam=0.1), balance=balance, lo=1960, hi=2010, leaky=True)
    assert leaky.predictions.count() > report.predictions.count()


def test_decade_prediction(corpus):
    table = year_prediction.signature_features(corpus, columns=["segments_timbre", "segments_pitches"])
    report, unseen = year_prediction.predict_decades(table, numTrees=20, maxDepth=5)
    assert report.metrics.first().accuracy > report.accuracy.first()[0]
    assert unseen.count() == 0


def test_numeric_features(corpus):
    _, names = year_prediction.numeric_features(corpus)
    assert names == ["loudness"]


def test_a_forest_gets_partitions_by_rows_and_trees(spark):
    rows = spark.range(5000, numPartitions=1)
    dealt = training.spread(rows, 300, bag_bytes=200_000)
    assert dealt.rdd.getNumPartitions() == 30 and max(dealt.rdd.glom().map(len).collect()) < 300
    assert sorted(r.id for r in dealt.collect()) == list(range(5000))
    assert training.spread(rows, 300).rdd.getNumPartitions() == 1


def test_long_boosting_runs_over_cells_and_finds_what_it_finds_over_rows(spark):
    random = np.random.default_rng(3)
    points = random.integers(0, [5, 4, 3], (600, 3))
    label = points @ [1.0, -2.0, 0.5] + points[:, 0] * points[:, 2] + random.normal(size=600)
    data = [(i, [float(v) for v in p], float(y)) for i, (p, y) in enumerate(zip(points, label))]
    rows = spark.createDataFrame(data, "id int, x array<double>, label double").select("id", features.as_vector("x").alias("features"), "label")
    boosting = training.boosted_trees_long(maxIter=6)
    over_cells, over_rows = boosting.fit(rows), boosting.trees.fit(rows)
    assert isinstance(over_cells, training.CellModel)
    cells, plain = ({r.id: r.prediction for r in m.transform(rows).collect()} for m in (over_cells, over_rows))
    assert cells == pytest.approx(plain, abs=1e-9)
    # a gap, or cells as many as rows: boosting over the rows
    assert not isinstance(boosting.fit(rows.filter("id < 60")), training.CellModel)
    assert training.bin_cuts(rows.withColumn("label", F.when(F.col("id") == 7, float("nan")).otherwise(F.col("label"))), "features", "label", 32) is None


def test_long_boosting_cuts_a_feature_of_many_values_by_quantiles(spark):
    rows = spark.range(4000).select("id", features.as_vector(F.array(F.col("id") / 7.0, F.lit(1.0))).alias("features"), F.floor(F.col("id") / 1000).cast("double").alias("label"))
    model = training.boosted_trees_long(maxIter=3, maxBins=8).fit(rows)
    assert [len(c) for c in model.cuts] == [7, 0]
    wrong = model.transform(rows).filter(F.abs(F.col("prediction") - F.col("label")) > 0.01)
    assert wrong.count() < 40  # cuts lie within the quantiles' error of the steps


def test_a_network_gets_partitions_by_rows(spark, monkeypatch):
    monkeypatch.setattr(training.MultilayerPerceptronClassifier, "fit", lambda self, train: train.rdd.getNumPartitions())
    fit = lambda n: training.fit_perceptron_classifier(spark.range(n, numPartitions=1), classes=7, width=7)
    assert fit(100) == 1 and fit(700_000) >= 8


@pytest.fixture(scope="module")
def marked(spark):
    """Rows of three classes that two of four features tell, as many as fill Spark ML's blocks of 64."""
    random = np.random.default_rng(4)
    x = random.normal(size=(2048, 4))
    y = (x[:, 0] > 0).astype(float) + (x[:, 1] > 0.5)
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, label double")
    return df.select("id", features.as_vector("x").alias("features"), "label").coalesce(1).cache()


def test_a_network_over_blocks_takes_the_steps_of_spark_ml(marked):
    settings = {"layers": [4, 6, 5, 3], "blockSize": 64, "seed": 7, "tol": 1e-6}
    for steps, near in ((0, 0.0), (6, 1e-3), (25, 0.05)):
        plain = training.MultilayerPerceptronClassifier(maxIter=steps, **settings).fit(marked)
        over_blocks = training.BlockPerceptronClassifier(maxIter=steps, **settings).fit(marked.repartition(8))
        assert np.allclose(over_blocks.weights.toArray(), plain.weights.toArray(), atol=near)
    assert over_blocks.getMaxIter() == 25 and over_blocks.getLayers() == [4, 6, 5, 3]
    a, b = ({r.id: r.prediction for r in m.transform(marked).collect()} for m in (plain, over_blocks))
    assert sum(a[i] != b[i] for i in a) < 20


def test_a_large_network_is_trained_over_all_rows_in_blocks(marked, monkeypatch):
    monkeypatch.setattr(training, "spread", lambda train, _: train.repartition(8))
    seen, whole = [], network.mean_loss
    monkeypatch.setattr(network, "mean_loss", lambda table, *a: seen.append((table, a[2])) or whole(table, *a))
    model = training.fit_perceptron_classifier(marked, classes=3, width=4, tol=0.01)
    assert model.transform(marked).filter("label = prediction").count() > 2000
    assert seen[-1][1] is np.float64  # the end is computed in double precision
    assert sum(len(r.y) // 4 for r in seen[0][0].collect()) == 2048
    for column, value, told in (("label", 3.0, "label"), ("label", 0.5, "label"), ("label", None, "label"), ("features", None, "non-null")):
        bad = marked.withColumn(column, F.when(F.col("id") != 5, F.col(column)).otherwise(F.lit(value)))
        with pytest.raises(Exception, match=told):
            training.fit_perceptron_classifier(bad, classes=3, width=4, maxIter=1)


def test_the_gradient_of_a_network_is_the_slope_of_its_loss():
    random, layers = np.random.default_rng(1), [3, 5, 4, 3]
    flat = random.normal(size=sum((a + 1) * b for a, b in zip(layers, layers[1:])))
    x, y = random.normal(size=(3, 50)), random.integers(0, 3, 50).astype(np.int32)
    kernel = lambda w, kind=np.float64: network.Kernel(w, layers, kind)(x, y)
    found = kernel(flat)
    slopes = [(kernel(flat + e)[1] - kernel(flat - e)[1]) / 2e-6 for e in 1e-6 * np.eye(len(flat))]
    assert found[0] == 50 and np.allclose(found[2:], slopes, atol=1e-6) and np.allclose(kernel(flat, np.float32), found, atol=1e-4)
    # sure of its rows: a loss far below single precision's last digit of one, and one beyond its exponential
    sure = network.Kernel(np.array([40.0, -40.0, 0.0, 0.0]), [1, 2], np.float32)
    assert sure(np.array([[0.5]]), np.array([0], np.int32))[1] == pytest.approx(np.exp(-40.0), rel=1e-5)
    assert sure(np.array([[5.0]]), np.array([1], np.int32))[1] == pytest.approx(400.0)


def test_steps_go_on_in_double_precision_if_single_misleads():
    def loss(x, kind):
        at = np.float64(kind(x[0]))  # single precision does not tell values near a million apart by less than a sixteenth
        return (at - 1e6 - 0.01) ** 2, np.array([2 * (at - 1e6 - 0.01)])

    found, _ = network.minimise(loss, np.array([1e6 + 3.0]), 100, 1e-9)
    assert found[0] == pytest.approx(1e6 + 0.01, abs=1e-5)


def test_a_forest_of_many_nodes_is_fitted_and_scored_in_parts(marked):
    weighted = marked.withColumn("weight", F.lit(1.0))
    model = training.fit_forest_classifier(weighted, numTrees=11, maxDepth=6, forest_nodes=100)
    assert isinstance(model, training.ForestParts) and len(model.paths) > 2
    assert sum(model.trees) == 11 and min(model.trees) >= 2 and max(model.nodes) < 400
    scored = model.transform(marked)
    assert scored.columns == [*marked.columns, "rawPrediction", "probability", "prediction"]
    parts = [training.RandomForestClassificationModel.load(p) for p in model.paths]
    assert len({p.toDebugString.partition("\n")[2] for p in parts}) == len(parts)  # each part draws rows of its own
    votes = sum(np.array([r.rawPrediction.toArray() for r in p.transform(marked).orderBy("id").collect()]) for p in parts)
    found = scored.orderBy("id").collect()
    assert np.allclose([r.rawPrediction.toArray() for r in found], votes) and np.allclose(votes.sum(axis=1), 11)
    assert [r.prediction for r in found] == votes.argmax(axis=1).tolist()
    assert np.allclose([r.probability.toArray() for r in found], votes / 11)
    assert sum(r.prediction == r.label for r in found) > 1950
    plain = training.fit_forest_classifier(weighted, numTrees=11, maxDepth=6)
    assert isinstance(plain, training.RandomForestClassificationModel)
