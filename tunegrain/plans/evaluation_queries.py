"""Model quality over tables of labels and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunegrain.operators import evaluation
from tunegrain.plans.registry import query, rounded, table

# A fixed linear rule stands in for a regressor: price per unit of quantity.
_PREDICTED = "(select l_extendedprice as label, l_quantity * 1500.0 + 500.0 as prediction from lineitem)"


def _regression(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500.0 + 500.0).alias("prediction")
    )


def _classification(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


_CLASSIFIED = "(select quality as label, toxic as prediction from labels)"


@query("regression_metrics", f"""
select round(sqrt(avg(e * e)), 3) as rmse, round(avg(e * e), 0) as mse, round(avg(abs(e)), 3) as mae,
  round(1 - avg(e * e) / var_pop(label), 4) as r2 from (select label, label - prediction as e from {_PREDICTED})""")
def regression_metrics(spark, d):
    score = evaluation.regression_metrics(_regression(spark, d))
    digits = {"rmse": 3, "mse": 0, "mae": 3, "r2": 4}
    return score.select(*[F.round(c, n).alias(c) for c, n in digits.items()])


@query("exact_accuracy", f"""
select count_if(label = prediction)::bigint as exact, count(*) as total,
  round(avg((label = prediction)::int), 6) as accuracy from {_CLASSIFIED}""")
def exact_accuracy(spark, d):
    return rounded(evaluation.exact_accuracy(_classification(spark, d)))


@query("error_histogram", f"""
with e as (select label - prediction as e from {_PREDICTED}), s as (select min(e) as lo, max(e) as hi from e),
n as (select least(floor((e - lo) / ((hi - lo) / 30))::int, 29) as bin, count(*) as n from e, s group by 1)
select b.bin::int as bin, round(lo + bin * ((hi - lo) / 30), 4) as lo, round(lo + (bin + 1) * ((hi - lo) / 30), 4) as hi,
  coalesce(n, 0)::bigint as n from (select unnest(range(0, 30)) as bin) b left join n using (bin), s""")
def error_histogram(spark, d):
    return rounded(evaluation.error_histogram(_regression(spark, d)), 4)


@query("confusion_matrix", f"select label, prediction, count(*) as n from {_CLASSIFIED} group by 1, 2")
def confusion_matrix(spark, d):
    return evaluation.confusion_matrix(_classification(spark, d))


_REPORT = f"""
with k as (select label as c from {_CLASSIFIED} union select prediction from {_CLASSIFIED}),
p as (select c, (select count(*) from {_CLASSIFIED} where label = c) as support,
  (select count(*) from {_CLASSIFIED} where prediction = c) as predicted,
  (select count(*) from {_CLASSIFIED} where label = c and prediction = c) as correct from k),
r as (select c as label, coalesce(correct / nullif(predicted, 0), 0) as precision, coalesce(correct / nullif(support, 0), 0) as recall,
  coalesce(2.0 * correct / nullif(predicted + support, 0), 0) as f1, support from p)"""


@query("class_report", f"{_REPORT} select label, round(precision, 6) as precision, round(recall, 6) as recall, "
                       f"round(f1, 6)::double as f1, support from r")
def class_report(spark, d):
    return rounded(evaluation.class_report(_classification(spark, d)))


@query("classification_metrics", f"""{_REPORT}
select round(sum(recall * support) / sum(support), 6) as accuracy, round(sum(precision * support) / sum(support), 6) as precision,
  round(sum(recall * support) / sum(support), 6) as recall, round(sum(f1 * support) / sum(support), 6)::double as f1 from r""")
def classification_metrics(spark, d):
    return rounded(evaluation.classification_metrics(_classification(spark, d)))


@query("class_distribution", "select lang, count(*) as n from documents group by lang")
def class_distribution(spark, d):
    return evaluation.class_distribution(table(spark, d, "documents"), "lang")


@query("n_classes", "select count(distinct event_type) as n_classes from events")
def n_classes(spark, d):
    return evaluation.n_classes(table(spark, d, "events"), "event_type")


@query("majority_baseline", "select round(max(n) / sum(n), 6) as baseline_accuracy from "
                            "(select lang, count(*) as n from documents group by 1)")
def majority_baseline(spark, d):
    return rounded(evaluation.majority_baseline(table(spark, d, "documents"), "lang"))


@query("class_weights", "select lang, n, round((select count(*) from documents) / (count(*) over () * n::double), 6) "
                        "as weight from (select lang, count(*) as n from documents group by 1)")
def class_weights(spark, d):
    return rounded(evaluation.class_weights(table(spark, d, "documents"), "lang"))


@query("weighted_rows", """
with w as (select lang, (select count(*) from documents) / (count(*) over () * n::double) as weight
  from (select lang, count(*) as n from documents group by 1))
select doc_id, documents.lang, round(weight, 6) as weight from documents join w using (lang)""")
def weighted_rows(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "lang")
    return rounded(evaluation.with_class_weights(documents, "lang")).select("doc_id", "lang", "weight")
