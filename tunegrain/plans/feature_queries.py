"""Scaling, polynomial terms, label indexes, correlation and principal components."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunegrain.operators import cleaning, features
from tunegrain.plans.registry import query, rounded, table
from tunegrain.runtime import new_folder
from tunegrain.sources.songs import write_matrix_csv

_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
_KEYS = ["l_orderkey", "l_linenumber"]
_WIDTH = 64
_DIMS = [f"d{i}" for i in range(_WIDTH)]


def _lines(spark, d):
    return table(spark, d, "lineitem").select(*_KEYS, *_COLS)


def _scaled(spark, d, scaler):
    lines = _lines(spark, d)
    model = features.chain(features.assemble(_COLS, "raw"), scaler).fit(lines)
    return rounded(features.vector_columns(model.transform(lines), "scaled", _COLS, _KEYS), 4)


def _scale_sql(stats: str, expr: str) -> str:
    found = ", ".join(stats.format(c=c) for c in _COLS)
    shown = ", ".join(f"round({expr.format(c=c)}, 4) as {c}" for c in _COLS)
    return f"with s as (select {found} from lineitem) select l_orderkey, l_linenumber, {shown} from lineitem, s"


@query("standard_scale", _scale_sql("avg({c}) as m_{c}, stddev_samp({c}) as s_{c}", "({c} - m_{c}) / s_{c}"))
def standard_scale(spark, d):
    return _scaled(spark, d, features.standard_scaler("raw", "scaled"))


@query("deviation_scale", _scale_sql("stddev_samp({c}) as s_{c}", "{c} / s_{c}"))
def deviation_scale(spark, d):
    return _scaled(spark, d, features.standard_scaler("raw", "scaled", with_mean=False))


@query("minmax_scale", _scale_sql("min({c}) as a_{c}, max({c}) as b_{c}", "({c} - a_{c}) / (b_{c} - a_{c})"))
def minmax_scale(spark, d):
    return _scaled(spark, d, features.minmax_scaler("raw", "scaled"))


@query("robust_scale", _scale_sql(
    "quantile_cont({c}, 0.5) as m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) as r_{c}",
    "({c} - m_{c}) / r_{c}"))
def robust_scale(spark, d):
    return rounded(features.robust_scaled(_lines(spark, d), _COLS), 4)


@query("robust_sketch")
def robust_sketch(spark, d):
    """The sketch-based scaler: its medians and ranges are close to the exact ones, not equal."""
    return _scaled(spark, d, features.robust_scaler("raw", "scaled"))


@query("exact_percentiles", " union all ".join(
    f"select '{c}' as \"column\", {p}::double as prob, round(quantile_cont({c}, {p}), 6) as value from lineitem"
    for c in _COLS for p in (0.01, 0.5, 0.999)))
def exact_percentiles(spark, d):
    from tunegrain.operators.quantiles import exact_percentiles as run

    return rounded(run(table(spark, d, "lineitem"), _COLS, [0.01, 0.5, 0.999]))


@query("poly_expand", """
select l_orderkey, l_linenumber, round(x, 6) as x, round(x * x, 6) as xx, round(y, 6) as y, round(x * y, 6) as xy,
  round(y * y, 6) as yy from (select l_orderkey, l_linenumber, l_quantity as x, l_discount as y from lineitem)""")
def poly_expand(spark, d):
    lines = _lines(spark, d)
    stages = features.chain(features.assemble(["l_quantity", "l_discount"], "raw"), features.polynomial("raw", "poly"))
    expanded = stages.fit(lines).transform(lines)
    return rounded(features.vector_columns(expanded, "poly", ["x", "xx", "y", "xy", "yy"], _KEYS))


@query("index_by_frequency", """
with c as (select lang, count(*) as n from documents group by 1),
i as (select lang, (row_number() over (order by n desc, lang) - 1)::double as label from c)
select doc_id, documents.lang, label from documents join i using (lang)""")
def index_by_frequency(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "lang")
    return features.label_indexer("lang").fit(documents).transform(documents)


@query("index_by_name", """
with i as (select event_type, (row_number() over (order by event_type) - 1)::double as label
  from (select distinct event_type from events))
select event_id, events.event_type, label, events.event_type as restored from events join i using (event_type)""")
def index_by_name(spark, d):
    """Alphabetical labels and their way back to the names."""
    events = table(spark, d, "events").select("event_id", "event_type")
    model = features.label_indexer("event_type", by="alphabet").fit(events)
    return features.label_names(model, "label", "restored").transform(model.transform(events))


@query("class_index", """
with i as (select year, (row_number() over (order by year) - 1)::int as label
  from (select distinct year(o_orderdate)::int as year from orders))
select o_orderkey, year, label from (select o_orderkey, year(o_orderdate)::int as year from orders) join i using (year)""")
def class_index(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return features.with_class_index(orders, "year")


@query("unseen_classes", "select distinct p_size from part where p_retailprice < 1000 "
                         "except select distinct p_size from part where p_retailprice >= 1000 and p_size < 40")
def unseen_classes(spark, d):
    part = table(spark, d, "part")
    train = part.filter((F.col("p_retailprice") >= 1000) & (F.col("p_size") < 40))
    return features.unseen_classes(train, part.filter(F.col("p_retailprice") < 1000), "p_size")


def _vectors(spark, d):
    """Vectors as numeric columns, all 64 of them."""
    return cleaning.flatten_array(
        table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e")),
        "e", _WIDTH, "d",
    ).withColumnsRenamed({f"d_{i}": f"d{i}" for i in range(_WIDTH)})


def _corr_sql(i: int, j: int) -> str:
    return f"round(corr(embedding[{i + 1}]::double, embedding[{j + 1}]::double), 6)"


_CORR = (
    "with c as (select [" + ", ".join(_corr_sql(i, j) for i in range(_WIDTH) for j in range(_WIDTH))
    + f"] as r from embeddings), k as (select unnest(range(0, {_WIDTH * _WIDTH}))::int as k, unnest(r) as r from c), "
    f"m as (select 'd' || (k // {_WIDTH}) as a, 'd' || (k % {_WIDTH}) as b, k // {_WIDTH} as i, k % {_WIDTH} as j, r from k)"
)


@query("correlation_matrix", f"{_CORR} select * from m")
def correlation_matrix(spark, d):
    return rounded(features.correlation_matrix(_vectors(spark, d), _DIMS))


@query("weak_pairs", f"{_CORR} select count_if(abs(r) < 0.05)::bigint as weak, count(*) as pairs, "
                     f"round(count_if(abs(r) < 0.05) / count(*), 6) as share from m where i < j")
def weak_pairs(spark, d):
    return rounded(features.weak_pairs(features.correlation_matrix(_vectors(spark, d), _DIMS), 0.05))


@query("pair_correlation", "select round(corr(l_quantity, l_extendedprice), 6) as r from lineitem")
def pair_correlation(spark, d):
    return rounded(features.column_correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("matrix_csv", f"{_CORR} select a as feature, " + ", ".join(
    f"max(case when j = {j} then r end) as d{j}" for j in range(_WIDTH)) + " from m group by a")
def matrix_csv(spark, d):
    """The correlation table written as CSV and read back."""
    matrix = features.wide_matrix(features.correlation_matrix(_vectors(spark, d), _DIMS), _DIMS)
    path = new_folder(spark, "matrix")
    write_matrix_csv(matrix, path)
    schema = "feature string, " + ", ".join(f"{c} double" for c in _DIMS)
    return rounded(spark.read.option("header", "true").schema(schema).csv(path))


def _standardised(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", features.as_vector("embedding").alias("raw"))
    return features.standard_scaler("raw", "scaled").fit(rows).transform(rows)


@query("explained_variance")
def explained_variance(spark, d):
    rows = _standardised(spark, d)
    return rounded(features.explained_variance(rows, features.pca("scaled", "components", 64).fit(rows)))


@query("pca_reduction")
def pca_reduction(spark, d):
    """Components cut at nine tenths of the variance; their variances add up to the explained part."""
    rows = _standardised(spark, d)
    model, k = features.fit_reduction(rows, "scaled", "reduced", 0.9)
    names = [f"pc{i + 1}" for i in range(k)]
    spread = features.vector_columns(model.transform(rows), "reduced", names, ["vec_id"])
    return spread.agg(*[F.round(F.var_samp(c), 6).alias(c) for c in names])


@query("pca_two_columns", """
with c as (select abs(corr(l_quantity, l_extendedprice)) as r from lineitem)
select 1 as component, round((1 + r) / 2, 6) as explained, round((1 + r) / 2, 6) as cumulative, round(1 + r, 6) as variance from c
union all select 2, round((1 - r) / 2, 6), 1.0, round(1 - r, 6) from c""")
def pca_two_columns(spark, d):
    """For two standardised columns the components follow from their correlation."""
    lines = features.assemble(["l_quantity", "l_extendedprice"], "raw").transform(_lines(spark, d))
    scaled = features.standard_scaler("raw", "scaled").fit(lines).transform(lines)
    model = features.pca("scaled", "components", 2).fit(scaled)
    spread = features.vector_columns(model.transform(scaled), "components", ["1", "2"])
    variances = cleaning.column_deviations(spread, ["1", "2"]).select(
        F.col("column").cast("int").alias("component"), (F.col("std") * F.col("std")).alias("variance")
    )
    return rounded(features.explained_variance(scaled, model).join(variances, "component"))
