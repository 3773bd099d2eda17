"""Models recomputed from what they wrote, and certificates that must fail for worse models."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tunegrain.operators import certificates, descent, features, graph, moments, sampling, training
from tunegrain.plans.registry import table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = table(spark, FOLDER, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), features.as_vector("embedding").alias("features")
    )
    return sampling.split(rows, "vec_id", 0.8)


def forward_sql(layers: int, hidden: str) -> str:
    """Outputs (vec_id, j, z) of a network whose weights and biases lie in tables (layer, i, j, w) and (layer, j, b)."""
    sql = "with z0 as (select vec_id, j, x as z from input)"
    for k in range(layers):
        z = f"select a.vec_id, w.j, sum(a.z * w.w) + any_value(b.b) as z from z{k} a join weight w on w.layer = {k} and w.i = a.j join bias b on b.layer = {k} and b.j = w.j group by 1, 2"
        sql += f", z{k + 1} as ({z})" if k == layers - 1 else f", z{k + 1} as (select vec_id, j, {hidden} as z from ({z}))"
    return f"{sql} select vec_id, j, z from z{layers}"


def run_forward(test, blocks, hidden, path):
    """The forward pass in DuckDB over written weights."""
    weight = [(k, i, j, float(w[i, j])) for k, (w, _) in enumerate(blocks) for i in range(w.shape[0]) for j in range(w.shape[1])]
    bias = [(k, j, float(b[j])) for k, (_, b) in enumerate(blocks) for j in range(len(b))]
    spark = test.sparkSession
    spark.createDataFrame(weight, "layer int, i int, j int, w double").write.parquet(f"{path}/weight")
    spark.createDataFrame(bias, "layer int, j int, b double").write.parquet(f"{path}/bias")
    test.select("vec_id", F.posexplode(vector_to_array("features")).alias("j", "x")).write.parquet(f"{path}/input")
    con = duckdb.connect()
    for name in ("weight", "bias", "input"):
        con.execute(f"create view {name} as select * from read_parquet('{path}/{name}/*.parquet')")
    return con.execute(forward_sql(len(blocks), hidden)).fetchall()


def test_perceptron_classes_by_sql(vectors, tmp_path):
    train, test = vectors
    model = training.fit_perceptron_classifier(train, classes=10, width=64, maxIter=30)
    flat, blocks, at, layers = model.weights.toArray(), [], 0, [64, 64, 32, 10]
    for n_in, n_out in zip(layers, layers[1:]):
        # weights of a layer are stored by column, its biases behind them
        end = at + n_in * n_out
        blocks.append((flat[at:end].reshape(n_out, n_in, order="F").T, flat[end: end + n_out]))
        at = end + n_out
    outputs = {}
    for vec_id, j, z in run_forward(test, blocks, "1 / (1 + exp(-z))", str(tmp_path)):
        outputs.setdefault(vec_id, {})[j] = z
    predicted = {r.vec_id: r.prediction for r in model.transform(test).collect()}
    assert predicted == {v: float(max(o, key=o.get)) for v, o in outputs.items()}


def test_perceptron_years_by_sql(vectors, tmp_path):
    train, test = vectors
    model = descent.PerceptronRegressor(key="vec_id", features_col="features", label_col="label", epochs=5).fit(train)
    blocks = descent._unpack(model.flat, model.layers)
    outputs = {v: z for v, _, z in run_forward(test, blocks, "greatest(z, 0)", str(tmp_path))}
    predicted = {r.vec_id: r.prediction for r in model.transform(test).collect()}
    assert outputs.keys() == predicted.keys() and all(outputs[v] == pytest.approx(p, abs=1e-9) for v, p in predicted.items())


def test_factorization_by_sql(vectors, tmp_path):
    """Predictions and loss, row by row, from the intercept, the linear part and the factors as written."""
    train, test = vectors
    model = training.factorization_machine(maxIter=50).fit(train)
    spark = test.sparkSession
    factors, linear = model.factors.toArray(), model.linear.toArray()
    spark.createDataFrame(
        [(j, k, float(linear[j]), float(factors[j, k])) for j in range(64) for k in range(4)], "j int, k int, w double, v double"
    ).write.parquet(f"{tmp_path}/factor")
    test.select("vec_id", "label", F.posexplode(vector_to_array("features")).alias("j", "x")).write.parquet(f"{tmp_path}/input")
    found = duckdb.execute(f"""
        with p as (select vec_id, k, sum(x * v) as s, sum(x * x * v * v) as q, sum(x * w) as l from read_parquet('{tmp_path}/input/*.parquet')
          join read_parquet('{tmp_path}/factor/*.parquet') using (j) group by 1, 2)
        select vec_id, {model.intercept!r} + any_value(l) + sum(s * s - q) / 2 from p group by 1""").fetchall()
    predicted = {r.vec_id: r.prediction for r in model.transform(test).collect()}
    assert {v: pytest.approx(z, abs=1e-9) for v, z in found} == predicted


def test_moments_tell_the_best_weights_from_others(vectors):
    train, _ = vectors
    y = np.array([r.label for r in train.select("label").collect()])
    for steps, best in ((100, True), (1, False)):
        model = training.fit_logistic(train, maxIter=steps).stages[0]
        found = {(r["class"], r.feature): r.moment for r in certificates.logistic_moments(model, train, 0.01).collect()}
        x = np.array([r.x for r in train.select(vector_to_array("features").alias("x")).collect()])
        slope = max(abs(found[k, j] - ((y == k) * (x[:, j] if j >= 0 else 1)).mean()) for k, j in found)
        assert (slope < 2e-4) == best


def test_best_splits(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 9, (300, 2)).astype(float), rng.normal(size=300) + 1e6
    rows = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 5.0), (1.0, 1.0, None)]
    found = {r.feature: (r.threshold, r.gain) for r in certificates.best_splits(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y").collect()}
    for i in range(2):
        cuts = [(y.var() - sum(part.var() * len(part) for part in (y[x[:, i] < c], y[x[:, i] > c])) / len(y), -c) for c in np.arange(0.5, 8)]
        gain, cut = max(cuts)
        assert found[i][0] == -cut and found[i][1] == pytest.approx(gain, rel=1e-6)


def test_components_from_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 1e5
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(200, None)], "i int, f array<double>")
    for batch, (a, b) in {"one": (0, 50), "two": (50, 120), "three": (120, 201), "none": (300, 400)}.items():
        moments.add_batch(rows.filter(F.col("i").between(0, 199)), "f", str(tmp_path), batch)  # replaced by the next
        moments.add_batch(rows.filter((F.col("i") >= a) & (F.col("i") < b)), "f", str(tmp_path), batch)
    model = moments.fit_components(spark, str(tmp_path), 4)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert model.n == 200 and np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.variances, values[:4], rtol=1e-6)
    assert np.allclose(model.vectors @ model.vectors.T, np.eye(4)) and model.total == pytest.approx(values.sum())
    known = rows.filter("f is not null")
    projected = np.array([r.p for r in model.project(known, "f", "p").orderBy("i").collect()])
    assert np.allclose(projected.var(axis=0, ddof=1), values[:4], rtol=1e-6)
    parts = moments.kept_and_left(known, "f", model.mean, model.vectors).agg(F.sum("kept"), F.sum("left")).first()
    assert np.allclose(parts, [values[:4].sum() * 199, values[4:].sum() * 199], rtol=1e-6)


def test_first_per_key_by_hash(spark):
    rows = [("a", 2, None, 1.0), ("a", None, 7, 2.0), ("a", None, None, 3.0), (None, 5, 1, 4.0), (None, 5, 0, 5.0), ("b", -9, 2**62, 6.0), ("b", -9, -(2**62), 7.0)]
    df = spark.createDataFrame(rows, "k string, p int, q long, v double")
    expected = {("a", 3.0), (None, 5.0), ("b", 7.0)}
    first = graph.first_per_key(df, "k", ["p", "q"])
    assert {(r.k, r.v) for r in first.collect()} == expected
    assert "SortAggregate" not in first.select("k")._jdf.queryExecution().sparkPlan().toString()
    stamped = df.withColumn("t", F.timestamp_seconds("p")).withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("p")))
    assert {(r.k, r.v) for r in graph.first_per_key(stamped, "k", ["t", "q"]).collect()} == expected
    assert {(r.k, r.v) for r in graph.first_per_key(stamped, "k", ["d", "q"]).collect()} == expected
    assert {(r.k, r.v) for r in graph.first_per_key(stamped.withColumn("s", F.col("t").cast("string")), "k", ["s", "q"]).collect()} == expected
    assert graph.first_per_key(df.filter("false"), "k", ["p", "q"]).count() == 0
