"""Fitted models whose results SQL can work out without the model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tunegrain.functions.hashing import fraction_cut
from tunegrain.operators import certificates, features, moments, sampling, training
from tunegrain.plans.registry import hash_sql, query, table
from tunegrain.runtime import new_folder

_EMBEDDED = "select vec_id, label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as j from embeddings"


@query("logistic_moments", f"""
with r as ({_EMBEDDED} where {hash_sql('vec_id')} < {fraction_cut(0.8)}),
t as (select vec_id, label from embeddings where {hash_sql('vec_id')} < {fraction_cut(0.8)}),
k as (select distinct label from t), n as (select count(*) as n from t)
select k.label::int as class, j::int as feature, round(sum(case when r.label = k.label then x else 0 end) / any_value(n), 3) + 0.0 as moment from r, k, n group by 1, 2
union all select label::int, -1, round(count(*) / any_value(n), 3) from t, n group by 1""")
def logistic_moments(spark, d):
    """At the best weights, probabilities and labels have the same moments but for the penalty's share: the gradient is zero."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), features.as_vector("embedding").alias("features"))
    train, _ = sampling.split(rows, "vec_id", 0.8)
    model = training.fit_logistic(train).stages[0]
    found = certificates.logistic_moments(model, train, 0.01)
    return found.withColumn("moment", F.round("moment", 3) + F.lit(0.0))


_CUT = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
_SPLITS = " union all ".join(
    f"select {i} as feature, {c}::double as value, count(*) as n, sum(l_extendedprice - m) as s, sum((l_extendedprice - m) ** 2) as q from lineitem, mean group by 2"
    for i, c in enumerate(_CUT)
)
_SPLITS_SQL = f"""
with mean as (select avg(l_extendedprice) as m from lineitem), v as ({_SPLITS}),
c as (select feature, (value + lead(value) over w) / 2 as threshold, sum(n) over w as ln, sum(s) over w as ls, sum(q) over w as lq,
  sum(n) over a as tn, sum(s) over a as ts, sum(q) over a as tq from v
  window w as (partition by feature order by value), a as (partition by feature)),
g as (select feature, threshold, (tq - ts * ts / tn - (lq - ls * ls / ln) - (tq - lq - (ts - ls) ** 2 / (tn - ln))) / tn as gain from c where threshold is not null),
b as (select feature, threshold, gain from g qualify row_number() over (partition by feature order by gain desc, threshold) = 1)"""


@query("best_splits", f"{_SPLITS_SQL} select feature::int as feature, threshold, round(gain / 1000, 3) as gain from b")
def best_splits(spark, d):
    found = certificates.best_splits(table(spark, d, "lineitem"), _CUT, "l_extendedprice")
    return found.withColumn("gain", F.round(F.col("gain") / 1000, 3))


@query("boosted_root", f"""{_SPLITS_SQL} select feature::int as feature, round(threshold, 6) as threshold, round(gain / 1000, 3) as gain
from b qualify row_number() over (order by gain desc) = 1""")
def boosted_root(spark, d):
    """The first round of boosting begins with the best cut of all."""
    lines = features.assemble(list(_CUT), "features").transform(table(spark, d, "lineitem").select(*_CUT, "l_extendedprice"))
    model = training.fit_boosted_trees(lines, label_col="l_extendedprice", maxBins=64, maxIter=1)
    roots = certificates.tree_roots(model).filter("tree = 0")
    return roots.select("feature", F.round("threshold", 6).alias("threshold"), F.round(F.col("gain") / 1000, 3).alias("gain"))


_STEP_KEY = "l_orderkey * 10 + l_linenumber"
_STEP_SQL = f"""select {_STEP_KEY} as song_id, (1950 + 5 * l_linenumber)::int as year, (1950 + 5 * l_linenumber)::double as prediction
from lineitem where {hash_sql(f'({_STEP_KEY})')} >= {fraction_cut(0.8)}"""


def _steps(spark, d):
    """Years that go up in steps with each of three features, beside one that tells nothing."""
    line = F.col("l_linenumber").cast("double")
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("song_id"), (1950 + 5 * F.col("l_linenumber")).cast("int").alias("year"),
        features.as_vector(F.array(line, -line, line * line)).alias("features"),
    )
    return sampling.split(rows, "song_id", 0.8)


def _whole(predicted):
    return predicted.select("song_id", "year", (F.round("prediction", 4) + F.lit(0.0)).alias("prediction"))


@query("forest_steps", _STEP_SQL)
def forest_steps(spark, d):
    """A forest of default size finds every step, whichever features a split may use."""
    train, test = _steps(spark, d)
    return _whole(training.fit_forest(train, label_col="year").transform(test))


@query("boosted_steps", _STEP_SQL)
def boosted_steps(spark, d):
    train, test = _steps(spark, d)
    return _whole(training.fit_boosted_trees(train, label_col="year").transform(test))


@query("boosted_year_steps", _STEP_SQL)
def boosted_year_steps(spark, d):
    """The longer boosting run on the scaled year, brought back to years."""
    train, test = _steps(spark, d)
    model = training.fit_year_model(train, training.boosted_trees_long(label_col="scaled"), "year", 1950, 2000, "scaled")
    return _whole(model.transform(test, as_float=True))


@query("perceptron_steps", f"""select {_STEP_KEY} as song_id, (l_linenumber - 1)::double as label, (l_linenumber - 1)::double as prediction
from lineitem where {hash_sql(f'({_STEP_KEY})')} >= {fraction_cut(0.8)}""")
def perceptron_steps(spark, d):
    """The network with its full settings tells seven classes that one of seven features marks."""
    line = F.col("l_linenumber")
    marks = F.array(*[(line == i).cast("double") for i in range(1, 8)])
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + line).alias("song_id"), (line - 1).cast("double").alias("label"), features.as_vector(marks).alias("features")
    )
    train, test = sampling.split(rows, "song_id", 0.8)
    return training.fit_perceptron_classifier(train, classes=7, width=7).transform(test).select("song_id", "label", "prediction")


# 180 features: 64 values, their squares, and 52 products of neighbours.
_WIDE_SQL = """
w as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
x as (select vec_id, vec_id % 4 as batch, unnest(list_concat(v, list_transform(v, lambda a: a * a), list_transform(range(1, 53), lambda i: v[i] * v[i + 1]))) as x,
  unnest(range(0, 180)) as j from w),
m as (select j, avg(x) as m from x group by j)"""


@query("incremental_pca", f"""
with {_WIDE_SQL} select batch, count(distinct vec_id) as n, round(sum((x - m) ** 2), 4) as spread from x join m using (j) group by 1""")
def incremental_pca(spark, d):
    """150 components of 180 features from the summaries of four batches; what they keep and what they leave is all the spread."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 4).alias("batch"), value.alias("v"))
    beside = F.transform(F.sequence(F.lit(0), F.lit(51)), lambda i: F.get("v", i) * F.get("v", i + 1))
    rows = rows.select("vec_id", "batch", F.concat("v", F.transform("v", lambda x: x * x), beside).alias("features"))
    path = new_folder(spark, "moments")
    for batch in range(4):
        moments.add_batch(rows.filter(F.col("batch") == batch), "features", path, f"batch{batch}")
    model = moments.fit_components(spark, path, 150)
    parts = moments.kept_and_left(rows, "features", model.mean, model.vectors)
    return parts.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("kept") + F.col("left")), 4).alias("spread"))


@query("pca_parts", f"""
with x as ({_EMBEDDED}), m as (select j, avg(x) as m from x group by j)
select label, count(distinct vec_id) as n, round(sum((x - m) ** 2), 4) as spread from x join m using (j) group by 1""")
def pca_parts(spark, d):
    """What 32 of 64 components keep of each class, with what they leave, is all its spread."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", features.as_vector("embedding").alias("features"))
    model = features.pca("features", "components", 32).fit(rows)
    mean = np.array(rows.select(F.posexplode(features.vector_to_array("features"))).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").toPandas()["m"])
    parts = moments.kept_and_left(rows, "features", mean, model.pc.toArray().T)
    return parts.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("kept") + F.col("left")), 4).alias("spread"))
