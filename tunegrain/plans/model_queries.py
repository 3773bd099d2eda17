"""Trained models; the ones with a closed form are checked against it."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tunegrain.functions.hashing import HASH_BITS, fraction_cut
from tunegrain.operators import descent, evaluation, features, ridge, sampling, training
from tunegrain.plans import year_prediction
from tunegrain.plans.registry import ORDER_YEARS_SQL, hash_sql, order_years, query, rounded, table

# --- closed forms ---------------------------------------------------------------------------

_X = "l_quantity", "l_discount"


def _lines(spark, d):
    lines = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    return features.assemble(_X, "features").transform(lines)


def _plane_sql(penalty: str) -> str:
    """Weights of two centred features under a ridge penalty added to their sums of squares."""
    return f"""
with m as (select avg(l_quantity) as m1, avg(l_discount) as m2, avg(l_extendedprice) as my, count(*) as n from lineitem),
s as (select sum((l_quantity - m1) ** 2) as a, sum((l_quantity - m1) * (l_discount - m2)) as b,
  sum((l_discount - m2) ** 2) as c, sum((l_quantity - m1) * (l_extendedprice - my)) as p,
  sum((l_discount - m2) * (l_extendedprice - my)) as q from lineitem, m),
r as (select a + {penalty} as a, b, c + {penalty} as c, p, q, m1, m2, my from s, m),
w as (select (c * p - b * q) / (a * c - b * b) as w1, (a * q - b * p) / (a * c - b * b) as w2, m1, m2, my from r)
select round(w1, 3) as w1, round(w2, 3) as w2, round(my - w1 * m1 - w2 * m2, 3) as intercept from w"""


def _weights(spark, weights, intercept):
    rows = [(round(float(weights[0]), 3), round(float(weights[1]), 3), round(float(intercept), 3))]
    return spark.createDataFrame(rows, "w1 double, w2 double, intercept double")


@query("linear_model", _plane_sql("0"))
def linear_model(spark, d):
    model = training.fit_linear(_lines(spark, d), label_col="l_extendedprice")
    return _weights(spark, model.coefficients, model.intercept)


@query("gaussian_glm", _plane_sql("0"))
def gaussian_glm(spark, d):
    model = training.fit_glm(_lines(spark, d), label_col="l_extendedprice")
    return _weights(spark, model.coefficients, model.intercept)


@query("ridge", _plane_sql("1.0"))
def ridge_plain(spark, d):
    model = ridge.fit_ridge(_lines(spark, d), label_col="l_extendedprice", alpha=1.0, per_row=False)
    return _weights(spark, model.weights, model.intercept)


@query("ridge_per_row", _plane_sql("0.01 * n"))
def ridge_per_row(spark, d):
    model = ridge.fit_ridge(_lines(spark, d), label_col="l_extendedprice", alpha=0.01)
    return _weights(spark, model.weights, model.intercept)


@query("ridge_loocv", """
with m as (select avg(l_quantity) as mx, avg(l_extendedprice) as my, count(*) as n from lineitem),
s as (select sum((l_quantity - mx) ** 2) + 0.01 * any_value(n) as g, sum((l_quantity - mx) * (l_extendedprice - my)) as p from lineitem, m),
r as (select l_extendedprice - my - (l_quantity - mx) * p / g as e, (l_quantity - mx) ** 2 / g as h from lineitem, m, s)
select round(avg((e / (1 - h)) ** 2), 0) as loocv_mse, round(avg(e ** 2), 0) as training_mse from r""")
def ridge_loocv(spark, d):
    lines = table(spark, d, "lineitem").select(F.array("l_quantity").alias("x"), "l_extendedprice")
    model = ridge.fit_ridge(lines, "x", "l_extendedprice", 0.01)
    return rounded(ridge.leave_one_out(lines, model), 0)


_SGD_BATCHES, _SGD_STEPS = 10, 800


def _priced(spark, d):
    """Order id, scaled customer number and price in units of a hundred thousand."""
    return table(spark, d, "orders").select(
        "o_orderkey", F.array(F.lit(1.0), F.col("o_custkey") / 100000.0).alias("x"),
        (F.col("o_totalprice") / 100000.0).alias("y"),
    )


@query("linear_sgd", f"""
with recursive r as (select o_custkey / 100000.0::double as x, o_totalprice / 100000.0::double as y,
  least(floor({hash_sql('o_orderkey')} * {_SGD_BATCHES / 2.0**HASH_BITS!r}::double)::int, {_SGD_BATCHES - 1}) as batch from orders),
b as (select batch, avg(x) as mx, avg(x * x) as mxx, avg(y) as my, avg(x * y) as mxy from r group by 1),
w(t, w0, w1) as (select 0, 0.0::double, 0.0::double
  union all select t + 1, w0 - 0.2 / sqrt(t + 1) * (w0 + mx * w1 - my), w1 - 0.2 / sqrt(t + 1) * (mx * w0 + mxx * w1 - mxy)
  from w join b on b.batch = w.t % {_SGD_BATCHES} where t < {_SGD_STEPS})
select round(w0, 6) as w0, round(w1, 6) as w1 from w where t = {_SGD_STEPS}""")
def linear_sgd(spark, d):
    model = descent.SGDRegressor(
        key="o_orderkey", features_col="x", label_col="y", steps=_SGD_STEPS, step=0.2, batch_fraction=1 / _SGD_BATCHES
    ).fit(_priced(spark, d))
    rows = [(round(float(model.weights[0]), 6), round(float(model.weights[1]), 6))]
    return spark.createDataFrame(rows, "w0 double, w1 double")


@query("parabola", """
with r as (select l_quantity as x, l_quantity * l_quantity as z, l_extendedprice as y from lineitem),
m as (select avg(x) as mx, avg(z) as mz, avg(y) as my, covar_pop(x, x) as a, covar_pop(x, z) as b, covar_pop(z, z) as c,
  covar_pop(x, y) as p, covar_pop(z, y) as q from r),
w as (select (c * p - b * q) / (a * c - b * b) as w1, (a * q - b * p) / (a * c - b * b) as w2, mx, mz, my from m),
e as (select y, y - (my + w1 * (x - mx) + w2 * (z - mz)) as e from r, w)
select round(sqrt(avg(e * e)), 2) as rmse, round(1 - avg(e * e) / var_pop(y), 5) as r2 from e""")
def parabola(spark, d):
    """Robust scaling, squares and least squares over one column."""
    lines = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    lines = features.assemble(["l_quantity"], "features").transform(lines)
    model = training.fit_linear_poly(lines, label_col="l_extendedprice")
    score = evaluation.regression_metrics(model.transform(lines), "l_extendedprice")
    return score.select(F.round("rmse", 2).alias("rmse"), F.round("r2", 5).alias("r2"))


# --- years from one number, checked end to end ------------------------------------------------

def _priced_years(spark, d):
    return order_years(spark, d).select(
        "song_id", "year", features.as_vector(F.array("price")).alias("features")
    )


@query("year_model", f"""
with w as (select regr_slope(year, price) as a, regr_intercept(year, price) as b from {ORDER_YEARS_SQL})
select song_id, year, ceil(greatest(1997.9, least(1998.2, a * price + b)))::int as prediction from {ORDER_YEARS_SQL}, w""")
def year_model(spark, d):
    """A fitted line, clipped to a narrow range and rounded up to whole years."""
    songs = _priced_years(spark, d)
    line = LinearRegression(featuresCol="features", labelCol="label")
    model = training.fit_year_model(songs, line, "year", 1997.9, 1998.2)
    return model.transform(songs).select("song_id", "year", "prediction")


@query("year_prediction", f"""
with s as (select *, {hash_sql('song_id')} as h from {ORDER_YEARS_SQL}),
b as (select *, case when year >= 2001 then 6 else year - 1995 end as bin from s where h < {fraction_cut(0.8)}),
c as (select bin, count(*) as c from b group by 1),
r as (select b.*, unnest(range(0, ceil(1500.0 / c.c)::int)) as replica from b join c using (bin)),
k as (select *, row_number() over (partition by bin order by replica, h, song_id) as rn from r),
w as (select regr_slope(year, price) as a, regr_intercept(year, price) as b0 from k where rn <= 1500),
p as (select year, greatest(1995, least(2001, a * price + b0)) as prediction from s, w where h >= {fraction_cut(0.8)})
select round(sqrt(avg((year - prediction) ** 2)), 4) as rmse, round(avg((year - prediction) ** 2), 4) as mse,
  round(avg(abs(year - prediction)), 4) as mae, round(1 - avg((year - prediction) ** 2) / var_pop(year), 4) as r2,
  count_if(year = ceil(prediction))::bigint as exact, count(*) as total, round(avg((year = ceil(prediction))::int), 4) as accuracy from p""")
def year_prediction_query(spark, d):
    """Split, balance the training years, fit, clip and score; at sf0.01 some years are repeated, some thinned out."""
    report = year_prediction.predict_years(
        _priced_years(spark, d),
        LinearRegression(featuresCol="features", labelCol="label"),
        balance=lambda df: sampling.balance_bins(df, "year", "song_id", 1995, 2001, width=1, n=1500),
        lo=1995, hi=2001,
    )
    accuracy = {c: report.accuracy.select(c).scalar().alias(c) for c in report.accuracy.columns}
    return rounded(report.metrics.select("*", *accuracy.values()), 4)


# --- fitted models, scored on held-out rows -------------------------------------------------


def _vectors(spark, d):
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), features.as_vector("embedding").alias("features")
    )
    return sampling.split(rows, "vec_id", 0.8)


def _regression_score(model, test):
    return rounded(evaluation.regression_metrics(model.transform(test)), 3)


def _class_score(predictions, label="label"):
    return rounded(evaluation.classification_metrics(predictions, label), 3)


@query("linear_poly")
def linear_poly(spark, d):
    """64 features and their products are 2,144 terms."""
    train, test = _vectors(spark, d)
    return _regression_score(training.fit_linear_poly(train, regParam=0.1), test)


@query("forest_regression")
def forest_regression(spark, d):
    train, test = _vectors(spark, d)
    return _regression_score(training.fit_forest(train), test)


@query("boosted_regression")
def boosted_regression(spark, d):
    train, test = _vectors(spark, d)
    return _regression_score(training.fit_boosted_trees(train), test)


@query("boosted_years")
def boosted_years(spark, d):
    """Boosted trees on the scaled label, predictions brought back into the label's range."""
    train, test = _vectors(spark, d)
    regressor = training.boosted_trees_long(label_col="scaled")
    model = training.fit_year_model(train, regressor, "label", 0, 9, "scaled")
    return _regression_score(model, test)


@query("factorization_years")
def factorization_years(spark, d):
    train, test = _vectors(spark, d)
    chain = features.chain(
        features.minmax_scaler("features", "unit"), training.factorization_machine("unit", "scaled")
    )
    return _regression_score(training.fit_year_model(train, chain, "label", 0, 9, "scaled"), test)


@query("perceptron_years")
def perceptron_years(spark, d):
    train, test = _vectors(spark, d)
    chain = features.chain(
        features.standard_scaler("features", "z"),
        descent.PerceptronRegressor(
            key="vec_id", features_col="z", label_col="scaled"
        ),
    )
    return _regression_score(training.fit_year_model(train, chain, "label", 0, 9, "scaled"), test)


@query("logistic_classes")
def logistic_classes(spark, d):
    train, test = _vectors(spark, d)
    predicted = training.fit_logistic(train).transform(test)
    return _class_score(predicted.withColumn("prediction", F.col("prediction").cast("double")))


@query("forest_classes")
def forest_classes(spark, d):
    train, test = _vectors(spark, d)
    weighted = evaluation.with_class_weights(train)
    return _class_score(training.fit_forest_classifier(weighted).transform(test))


@query("perceptron_classes")
def perceptron_classes(spark, d):
    train, test = _vectors(spark, d)
    model = training.fit_perceptron_classifier(train, classes=10, width=64)
    return _class_score(model.transform(test))
