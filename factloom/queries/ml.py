"""Features, model measures and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as M
from ..operators import models
from . import query
from .relational import r


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS o_orderdate_is_weekend FROM orders")
def date_parts(t):
    return M.date_parts(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS \"o_orderstatus_F\", CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatus_O\" FROM orders")
def one_hot(t):
    return M.one_hot(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"]).drop("o_orderstatus")


@query("SELECT p_partkey, round(count(*) OVER (PARTITION BY p_brand) / count(*) OVER (), 8) AS p_brand_freq FROM part")
def frequency_encode(t):
    return r(M.frequency_encode(t("part").select("p_partkey", "p_brand"), "p_brand"), 8, "p_brand_freq").drop("p_brand")


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 5) AS o_totalprice FROM orders")
def standardize(t):
    return r(M.standardize(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), 5, "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) <= ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) THEN 'test' ELSE 'train' END AS split FROM orders")
def stratified_split(t):
    return M.stratified_split(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey").drop("o_orderstatus")


GUESS = "SELECT quality AS truth, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 1 - toxic END AS predicted FROM labels"


def guess(t):
    return t("labels").select(F.col("quality").cast("int").alias("truth"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(1 - F.col("toxic")).cast("int").alias("predicted"), "doc_id")


@query(f"SELECT CAST(truth AS INTEGER) AS truth, CAST(predicted AS INTEGER) AS predicted, count(*) AS n FROM ({GUESS}) GROUP BY 1, 2")
def confusion_matrix(t):
    return M.confusion(guess(t), "truth", "predicted")


@query(f"""WITH g AS ({GUESS}), c AS (SELECT k AS label, count(*) FILTER (truth = k) AS s, count(*) FILTER (predicted = k) AS m, count(*) FILTER (truth = k AND predicted = k) AS tp FROM g, (SELECT unnest([0, 1]) AS k) GROUP BY 1), x AS (SELECT label, s, coalesce(tp / nullif(m, 0), 0) AS p, coalesce(tp / nullif(s, 0), 0) AS q FROM c WHERE s + m > 0)
    SELECT CAST(label AS INTEGER) AS label, round(p, 6) AS precision, round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1, s AS support FROM x""")
def class_metrics(t):
    return r(M.class_metrics(guess(t), "truth", "predicted"), 6, "precision", "recall", "f1")


@query("""WITH e AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem) SELECT count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(avg(y - p), 3) AS residual_mean, round(stddev_pop(y - p), 3) AS residual_std FROM e""")
def regression_metrics(t):
    df = t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return r(r(M.regression_metrics(df, "y", "p"), 3, "rmse", "mae", "residual_mean", "residual_std"), 6, "r2")


SCORED = "SELECT round(value, 0) AS s, event_type = 'error' AS y FROM events"


def scored(t):
    return t("events").select(F.round("value", 0).alias("s"), (F.col("event_type") == "error").alias("y"))


@query(f"""WITH b AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM ({SCORED}) GROUP BY 1) SELECT s AS threshold, round(sum(p) OVER (ORDER BY s DESC) / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER (ORDER BY s DESC) / sum(n) OVER (), 6) AS fpr FROM b""")
def roc_points(t):
    return r(M.roc_points(scored(t), F.col("y"), "s"), 6, "tpr", "fpr")


@query(f"""WITH k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM ({SCORED})), n AS (SELECT CAST(count(*) FILTER (y) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT y) AS DOUBLE) AS n, sum(r) FILTER (y) AS rs FROM k) SELECT round((rs - p * (p + 1) / 2) / (p * n), 6) AS auc FROM n""")
def auc(t):
    return r(M.auc(scored(t), F.col("y"), "s"), 6, "auc")


@query("SELECT count(DISTINCT o_totalprice) AS levels, CASE WHEN count(DISTINCT o_totalprice) = 2 THEN 'binary' WHEN count(DISTINCT o_totalprice) > 20 OR max(o_totalprice) - min(o_totalprice) > 20 THEN 'regression' ELSE 'multiclass' END AS task FROM orders")
def task_detection(t):
    return M.task_kind(t("orders"), "o_totalprice")


@query()
def ml_linear(t):
    return models.train(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "regression", "l_orderkey", ["linear"])[1]


@query()
def ml_random_forest(t):
    df = t("labels").join(t("documents"), "doc_id").select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("n_chars").cast("double").alias("n_chars"), F.col("toxic").cast("double").alias("toxic"))
    return models.train(df, "quality", ["n_chars", "toxic"], "binary", "doc_id", ["forest"])[1]


def quality(t):
    return t("labels").join(t("documents"), "doc_id").select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("n_chars").cast("double").alias("n_chars"), F.col("toxic").cast("double").alias("toxic"))


@query()
def ml_cross_validate(t):
    """Five folds of a linear model at two settings; tests hold it against plain least squares."""
    return models.cross_validate(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "regression", "linear", grid={"regParam": [0.0, 0.1]})[1]


@query()
def ml_importance(t):
    return models.feature_importance(models.train(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "regression", "l_orderkey", ["linear"])[0]["linear"])


@query()
def ml_predict(t):
    df = quality(t)
    made = models.train(df, "quality", ["n_chars", "toxic"], "binary", "doc_id", ["logistic"])[0]["logistic"]
    return models.predict(made, df).select("doc_id", "predicted")


@query()
def ml_mlp(t):
    return models.train(quality(t), "quality", ["n_chars", "toxic"], "binary", "doc_id", ["mlp"])[1]
