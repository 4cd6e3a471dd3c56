"""Profiles, roles, validation and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.overview import analyze_dataset as analyze
from . import query
from .relational import r

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM orders" for c in ORDERS))
def profile_columns(t):
    return P.profile(t("orders").select(*ORDERS))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe_numeric(t):
    return r(P.describe(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 4, "mean", "std", "min", "q1", "median", "q3", "max")


@query("SELECT p_brand AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def top_values(t):
    return r(P.top_values(t("part"), "p_brand"), 6, "share")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (abs({c} - m) / s > 3) AS n_outliers FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem)" for c in ("l_quantity", "l_extendedprice")))
def validate_zscore(t):
    return P.zscore_outliers(t("lineitem"), ["l_quantity", "l_extendedprice"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS nulls FROM documents" for c in ("text", "lang", "source")))
def validate_nulls(t):
    return P.profile(t("documents").select("text", "lang", "source")).select("column", "n_rows", "nulls")


@query("SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_distinct, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def validate_duplicates(t):
    return P.duplicate_rows(t("lineitem").select("l_orderkey", "l_linenumber"))


@query("""WITH a AS (SELECT list(DISTINCT l_returnflag) AS a, list(DISTINCT l_linestatus) AS b, count(*) FILTER (l_returnflag IS DISTINCT FROM l_linestatus) = 0 AS identical FROM lineitem)
    SELECT CAST(len(a) AS INTEGER) AS n_a, CAST(len(b) AS INTEGER) AS n_b, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS jaccard, identical FROM a""")
def category_overlap(t):
    return r(P.category_overlap(t("lineitem"), "l_returnflag", "l_linestatus"), 6, "jaccard")


@query("SELECT * FROM (VALUES ('o_orderkey', 'id'), ('o_custkey', 'id'), ('o_orderstatus', 'category'), ('o_totalprice', 'number'), ('o_orderdate', 'date'), ('o_orderpriority', 'category')) v(\"column\", role) WHERE (SELECT count(DISTINCT o_orderkey) = count(*) FROM orders)")
def column_roles(t):
    return P.roles(t("orders"))


@query("""WITH c AS (SELECT v, count(*) AS c, sum(count(*)) OVER () AS n FROM (SELECT CAST(CASE l_linenumber % 4 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 404 ELSE 500 END AS DOUBLE) AS v FROM lineitem) GROUP BY 1), k AS (SELECT *, c >= greatest(2, floor(n * 0.001)) AS ok FROM c)
    SELECT CAST(max(n) AS BIGINT) AS n, count(*) AS levels, count(*) FILTER (ok) AS recurring, max(v) FILTER (ok) - min(v) FILTER (ok) AS span, max(n) >= 10 AND count(*) BETWEEN 2 AND 25 AND count(*) FILTER (ok) >= 2 AND max(v) FILTER (ok) - min(v) FILTER (ok) >= 5 * count(*) FILTER (ok) AS coded FROM k""")
def coded_columns(t):
    k = F.col("l_linenumber") % 4
    return P.coded_column(t("lineitem").select(F.when(k == 0, 200).when(k == 1, 301).when(k == 2, 404).otherwise(500).alias("reply")), "reply")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(q1 - 1.5 * (q3 - q1), 4) AS low, round(q3 + 1.5 * (q3 - q1), 4) AS high, (SELECT count(*) FROM {tb} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {tb})" for c, tb in (("value", "events"),)))
def outlier_fences(t):
    return r(P.outlier_fences(t("events"), ["value"]), 4, "low", "high")


@query("SELECT 'revenue' AS target, 'l_quantity' AS a, '*' AS op, 'unit' AS b FROM lineitem LIMIT 1")
def derived_formula(t):
    df = t("lineitem").select("l_quantity", "l_tax", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    return P.derived_formulas(df.withColumn("revenue", F.col("l_quantity") * F.col("unit")))


@query("""WITH v AS (SELECT o_orderkey AS v, count(*) AS c FROM orders GROUP BY 1), s AS (SELECT sum(c) AS n, count(*) FILTER (v + 1 IN (SELECT v FROM v)) AS steps FROM v)
    SELECT CAST(n AS BIGINT) AS n, round(steps / (n - 1), 6) AS share, steps / (n - 1) >= 0.99 AS counter FROM s""")
def row_counter(t):
    return r(P.row_counter(t("orders"), "o_orderkey"), 6, "share")


@query("""SELECT 'day' AS "column", 0.0::DOUBLE AS number, 1.0::DOUBLE AS date, 1.0::DOUBLE AS year, 0.0::DOUBLE AS email, 0.0::DOUBLE AS clock, 0.0::DOUBLE AS padded
    UNION ALL SELECT 'code', 1.0, 0.0, round(avg(CASE WHEN regexp_matches('0' || o_orderkey, '(^|[^0-9])(19|20)[0-9]{2}($|[^0-9])') THEN 1.0 ELSE 0 END), 6), 0.0, 0.0, 1.0 FROM orders""")
def text_shapes(t):
    df = t("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit("0"), F.col("o_orderkey").cast("string")).alias("code"))
    return r(P.text_shapes(df), 6, "year")


def overview(t):
    """Orders with everything that can stand out: blanks in the same rows, copies, a constant, a code, lists, a rare label, many labels, a lopsided and an outlying number."""
    o = t("orders").select(
        "o_orderkey", "o_orderdate", "o_totalprice", F.lit("x").alias("same"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 11 * 1.5).alias("a"),
        F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("t"), (F.col("o_orderkey") % 3).cast("string"))).alias("b"), F.when(F.col("o_orderkey") % 20 == 0, "rare").otherwise("usual").alias("flag"),
        F.when(F.col("o_orderkey") % 3 == 0, "red, blue").when(F.col("o_orderkey") % 3 == 1, "red").otherwise("blue, green, red").alias("tags"), (F.col("o_orderkey") % 4 * 100 + 200).alias("http_status"),
        (F.pow(F.col("o_orderkey") % 7, 3) + 1.5).alias("lopsided"), F.when(F.col("o_orderkey") % 50 == 0, F.lit(9999.5)).otherwise(F.col("o_orderkey") % 10 + 0.5).alias("wild"),
    )
    return o.union(o.filter("o_orderkey % 1000 = 1"))


OVERVIEW = """d0 AS (SELECT o_orderkey AS k, o_orderdate, o_totalprice, o_custkey FROM orders), d AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE k % 1000 = 1),
    n AS (SELECT count(*)::DOUBLE AS n FROM d)"""


@query(f"""WITH {OVERVIEW},
    w AS (SELECT k % 11 * 1.5 AS a, k, o_totalprice AS p, (k % 7) ** 3 + 1.5 AS l, CASE WHEN k % 50 = 0 THEN 9999.5 ELSE k % 10 + 0.5 END AS w FROM d),
    f AS (SELECT quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3 FROM w)
    SELECT 'role' AS kind, unnest(['o_orderkey', 'o_orderdate', 'o_totalprice', 'same', 'customer', 'a', 'b', 'flag', 'tags', 'http_status', 'lopsided', 'wild']) AS subject, NULL::DOUBLE AS value,
        unnest(['number', 'date', 'number', 'constant', 'category', 'number', 'category', 'category', 'category', 'code', 'number', 'number']) AS text
    UNION ALL SELECT 'empty', unnest(['a', 'b']), count(*) FILTER (k % 4 = 0) / count(*), NULL FROM d
    UNION ALL SELECT 'block', 'a, b', count(*) FILTER (k % 4 = 0), NULL FROM d
    UNION ALL SELECT 'duplicates', 'rows', (SELECT n FROM n) - count(*), NULL FROM d0
    UNION ALL SELECT 'outliers', 'wild', count(*) FILTER (k % 50 = 0), NULL FROM d
    UNION ALL SELECT 'lopsided', 'lopsided', round(avg(l) / median(l), 6), NULL FROM w
    UNION ALL SELECT 'outliers', 'o_totalprice', count(*), NULL FROM w, f WHERE p < q1 - 1.5 * (q3 - q1) OR p > q3 + 1.5 * (q3 - q1) HAVING count(*) >= 0.01 * (SELECT n FROM n)
    UNION ALL SELECT 'list', 'tags', 3, ','
    UNION ALL SELECT 'imbalance', 'flag', round(count(*) FILTER (k % 20 <> 0) / count(*), 6), 'usual; ' || count(*) FILTER (k % 20 = 0) || ' other rows' FROM d
    UNION ALL SELECT 'cardinality', 'customer', count(DISTINCT o_custkey), NULL FROM d
    UNION ALL SELECT 'correlation', x.s, round(x.r, 6), NULL FROM (SELECT unnest(['o_orderkey ~ o_totalprice', 'o_totalprice ~ a', 'o_totalprice ~ lopsided', 'o_totalprice ~ wild']) AS s,
        unnest([corr(k, p), corr(p, CASE WHEN k % 4 <> 0 THEN a END), corr(p, l), corr(p, w)]) AS r FROM w) x
    UNION ALL SELECT 'from', 'o_orderdate', NULL, strftime(min(o_orderdate), '%Y-%m-%d') FROM d UNION ALL SELECT 'until', 'o_orderdate', NULL, strftime(max(o_orderdate), '%Y-%m-%d') FROM d
    UNION ALL SELECT 'next', unnest(['1', '2', '3', '4', '5', '6', '7']), unnest([1, 2, 3, 4, 5, 6, 7]), unnest(['clean_dataset', 'plot_column o_orderkey', 'analyze_multivalue tags', 'plot_relationship b o_orderkey', 'analyze_over_time o_orderdate o_orderkey', 'analyze_correlations', 'analyze_missing'])""")
def analyze_dataset(t):
    """Everything that stands out in a table where all of it occurs."""
    a = analyze(overview(t), target="o_totalprice")
    return a.withColumn("value", F.round("value", 6))
