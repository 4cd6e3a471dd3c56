"""Statistics and hypothesis tests. P-values have no SQL; their queries are checked by rows and by unit tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import statistics as P
from ..operators import statistics as S
from . import query
from .relational import r

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem")
def corr_pearson(t):
    return r(S.correlations(t("lineitem"), LINE[:2]), 6, "r")


_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM lineitem" for a, b in _PAIRS))
def corr_pairs(t):
    return r(S.correlations(t("lineitem"), LINE), 6, "r")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 6) AS strength FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def corr_target(t):
    pairs = S.correlations(t("lineitem"), LINE).filter("a = 'l_extendedprice' OR b = 'l_extendedprice'")
    return r(pairs.select(F.when(F.col("a") == "l_extendedprice", F.col("b")).otherwise(F.col("a")).alias("feature"), F.abs("r").alias("strength")), 6, "strength")


MID = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(f"WITH k AS (SELECT {MID.format(c='l_quantity')} AS a, {MID.format(c='l_extendedprice')} AS b FROM lineitem) SELECT round(corr(a, b), 6) AS r, count(*) AS n FROM k")
def corr_spearman(t):
    return r(S.spearman(t("lineitem"), "l_quantity", "l_extendedprice"), 6, "r")


@query("""WITH c AS (SELECT l_linenumber AS x, l_tax AS y, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2),
    s AS (SELECT sum(p.c * q.c * sign(p.x - q.x) * sign(p.y - q.y)) AS s FROM c p JOIN c q ON p.x < q.x),
    x AS (SELECT sum(t * (t - 1) / 2) AS tx, sum(t) AS n FROM (SELECT sum(c) AS t FROM c GROUP BY x)), y AS (SELECT sum(t * (t - 1) / 2) AS ty FROM (SELECT sum(c) AS t FROM c GROUP BY y))
    SELECT round(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) AS tau, CAST(n AS BIGINT) AS n FROM s, x, y""")
def corr_kendall(t):
    return r(S.kendall(t("lineitem"), "l_linenumber", "l_tax"), 6, "tau")


@query()
def corr_pvalue(t):
    df = t("lineitem")
    rows = S.correlations(df, LINE).collect()  # one row a pair of columns
    out = [(x["a"], x["b"], x["r"], x["n"], P.correlation_p(df.sparkSession, x["r"], x["n"]), P.strength(x["r"])) for x in rows]
    return df.sparkSession.createDataFrame(out, "a string, b string, r double, n long, p double, strength string")


TWO = "SELECT count(*) FILTER (o_orderstatus = 'F') AS n1, count(*) FILTER (o_orderstatus = 'O') AS n2, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS m1, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS m2, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS v1, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS v2 FROM orders"


@query(f"WITH g AS ({TWO}) SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 3) AS dof FROM g")
def welch_t(t):
    out = S.welch(t("orders"), "o_totalprice", "o_orderstatus", "F", "O")
    return r(r(out, 6, "t"), 3, "dof").select("t", "dof")


@query(f"WITH g AS ({TWO}) SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d FROM g")
def cohens_d(t):
    return r(S.welch(t("orders"), "o_totalprice", "o_orderstatus", "F", "O").select("d"), 6, "d")


ANOVA = "WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS n, sum((n - 1) * v) AS w, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b FROM g)"


@query(ANOVA + " SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS f, k - 1 AS dof_between, CAST(n - k AS BIGINT) AS dof_within FROM s")
def anova_f(t):
    return r(S.anova(t("orders"), "o_totalprice", "o_orderpriority").drop("eta_squared"), 4, "f")


@query(ANOVA + " SELECT round(b / (b + w), 6) AS eta_squared FROM s")
def eta_squared(t):
    return r(S.anova(t("orders"), "o_totalprice", "o_orderpriority").select("eta_squared"), 6, "eta_squared")


@query(f"""WITH k AS (SELECT l_returnflag AS g, l_quantity AS v, {MID.format(c='l_quantity')} AS r FROM lineitem), s AS (SELECT g, sum(r) AS s, count(*) AS c FROM k GROUP BY 1),
    o AS (SELECT count(*) AS groups, CAST(sum(c) AS DOUBLE) AS n, sum(s * s / c) AS q FROM s), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM k GROUP BY v))
    SELECT groups, CAST(n AS BIGINT) AS n, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)), 4) AS h FROM o, t""")
def rank_kruskal(t):
    return r(S.kruskal(t("lineitem"), "l_quantity", "l_returnflag"), 4, "h")


@query("""WITH p AS (SELECT l_returnflag AS label, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT corr(l_quantity, l_extendedprice) AS overall FROM lineitem)
    SELECT label, round(r, 6) AS r, n, round(overall, 6) AS overall, sign(r) <> sign(overall) AND abs(r) >= 0.05 AS reversed FROM p, o WHERE n >= 30""")
def subgroup_corr(t):
    return r(S.subgroup_correlations(t("lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"), 6, "r", "overall")


@query("""WITH x AS (SELECT o_orderpriority AS label, o_orderstatus AS c, CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0 END AS y FROM orders WHERE o_orderstatus IN ('F', 'O')),
    o AS (SELECT avg(y) FILTER (c = 'F') AS f, avg(y) FILTER (c = 'O') AS s FROM x), p AS (SELECT label, avg(y) FILTER (c = 'F') AS f, avg(y) FILTER (c = 'O') AS s, count(*) AS n FROM x GROUP BY 1)
    SELECT label, round(p.f, 6) AS first, round(p.s, 6) AS second, n, round(o.f, 6) AS overall_first, round(o.s, 6) AS overall_second, sign(p.f - p.s) <> sign(o.f - o.s) AS reversed FROM p, o WHERE n >= 30""")
def simpson_rates(t):
    out = S.simpson_rates(t("orders"), F.col("o_totalprice") > 150_000, "o_orderstatus", "o_orderpriority", "F", "O")
    return r(out, 6, "first", "second", "overall_first", "overall_second")


HOLED = "SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status, o_custkey AS cust FROM orders"


def holed(t):
    """Orders with holes: price and priority are missing together, status on its own."""
    o = t("orders")
    a, b = F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 5 != 0
    return o.select(F.when(a, F.col("o_totalprice")).alias("price"), F.when(a, F.col("o_orderpriority")).alias("priority"), F.when(b, F.col("o_orderstatus")).alias("status"), F.col("o_custkey").alias("cust"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END), 6) AS share FROM ({HOLED})" for c in ("price", "priority", "status", "cust")))
def missing_per_column(t):
    return r(S.missing_per_column(holed(t)), 6, "share")


@query(f"SELECT 'price' AS a, 'priority' AS b, round(corr(CASE WHEN price IS NULL THEN 1.0 ELSE 0 END, CASE WHEN priority IS NULL THEN 1.0 ELSE 0 END), 6) AS r FROM ({HOLED})")
def missing_blocks(t):
    return r(S.missing_blocks(holed(t), ["price", "priority", "status"]), 6, "r")


@query(f"""WITH k AS (SELECT price IS NULL AS f, cust AS v, {MID.format(c='cust')} AS r FROM ({HOLED})), s AS (SELECT count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, sum(r) FILTER (f) AS r1 FROM k), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM k GROUP BY v)),
    u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, CAST(n1 + n2 AS DOUBLE) AS n, ties FROM s, t)
    SELECT n1, n2, round(u, 2) AS u, round((u - CAST(n1 AS DOUBLE) * n2 / 2) / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u""")
def missing_mwu(t):
    return r(r(S.mann_whitney(holed(t), "cust", F.col("price").isNull()), 2, "u"), 6, "z")


@query(f"""WITH c AS (SELECT price IS NULL AS a, status AS b, CAST(count(*) AS DOUBLE) AS o FROM ({HOLED}) WHERE status IS NOT NULL GROUP BY 1, 2), n AS (SELECT sum(o) AS n FROM c), x AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), y AS (SELECT b, sum(o) AS rb FROM c GROUP BY 1)
    SELECT round(sum(pow(coalesce(o, 0) - ra * rb / n, 2) / (ra * rb / n)), 6) AS statistic, (count(DISTINCT x.a) - 1) * (count(DISTINCT y.b) - 1) AS dof FROM x CROSS JOIN y CROSS JOIN n LEFT JOIN c ON c.a = x.a AND c.b = y.b""")
def missing_chi2(t):
    return r(S.chi2_independence(holed(t), F.col("price").isNull(), F.col("status")), 6, "statistic")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def trend_line(t):
    return r(r(r(S.trend_line(t("lineitem"), "l_quantity", "l_extendedprice"), 4, "slope"), 3, "intercept"), 6, "r")


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, hi FROM orders, e)
    SELECT bin, round(lo + bin * (hi - lo) / 20, 3) AS low, round(lo + (bin + 1) * (hi - lo) / 20, 3) AS high, count(*) AS n FROM b GROUP BY bin, lo, hi""")
def histogram(t):
    return r(S.histogram(t("orders"), "o_totalprice", 20), 3, "low", "high")


@query("""WITH q AS (SELECT event_type AS label, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT label, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM events JOIN q ON event_type = label GROUP BY ALL""")
def box_stats(t):
    return r(S.box_stats(t("events"), "value", "event_type"), 4, "q1", "median", "q3")


@query("""WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS grand, sum((n - 1) * v) AS w FROM g),
    b AS (SELECT sum(g.n * (m - grand) * (m - grand)) AS b FROM g, t), e AS (SELECT (b / (k - 1)) / (w / (n - k)) AS f, b / (b + w) AS eta FROM b, t)
    SELECT round(f, 4) AS f, round(eta, 8) AS eta_squared, CASE WHEN eta >= 0.14 THEN 'large' WHEN eta >= 0.06 THEN 'medium' WHEN eta >= 0.01 THEN 'small' ELSE 'negligible' END AS size FROM e""")
def compare_groups_effect(t):
    """ANOVA's F and effect size with its word; the p-value is in ``compare_groups``, for which SQL has no distribution."""
    x = S.anova(t("orders"), "o_totalprice", "o_orderpriority")
    words = F.when(F.col("eta_squared") >= 0.14, "large").when(F.col("eta_squared") >= 0.06, "medium").when(F.col("eta_squared") >= 0.01, "small").otherwise("negligible")
    return r(r(x.select("f", "eta_squared", words.alias("size")), 4, "f"), 8, "eta_squared")


@query()
def compare_groups(t):
    """ANOVA with its p-value and effect size, in words."""
    df = t("orders")
    x = S.anova(df, "o_totalprice", "o_orderpriority").first()
    p = P.f_upper(df.sparkSession, x["f"], x["dof_between"], x["dof_within"])
    row = (x["f"], p, x["eta_squared"], P.eta_size(x["eta_squared"]), p < 0.05)
    return df.sparkSession.createDataFrame([row], "f double, p double, eta_squared double, size string, significant boolean")


def gaps(t):
    """Scores that are blank for most large orders and for every twentieth."""
    blank = ((F.col("o_totalprice") > 200_000) & (F.col("o_orderkey") % 3 != 0)) | (F.col("o_orderkey") % 20 == 0)
    return t("orders").select("o_totalprice", "o_custkey", "o_orderpriority", F.when(F.col("o_totalprice") > 200_000, "large").otherwise("small").alias("size"), F.when(~blank, F.col("o_orderkey") * 1.0).alias("score"))


#: Four tests together at 0.05: the normal score and the chi-squares (of one and four degrees) beyond which each is below 0.0125.
BEYOND = {"z": 2.497705474, "one": 6.238532637, "four": 12.761851398}
GAPS = "g AS (SELECT o_totalprice, o_custkey::DOUBLE AS o_custkey, o_orderpriority, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size, (o_totalprice > 200000 AND o_orderkey % 3 <> 0) OR o_orderkey % 20 = 0 AS blank FROM orders)"


def _ranked(c: str) -> str:
    return f"""(SELECT '{c}' AS driver, 'number' AS kind, (abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS statistic, hi AS high, lo AS low, NULL AS label FROM (
        SELECT count(*)::DOUBLE AS n, (count(*) FILTER (blank))::DOUBLE AS n1, (count(*) FILTER (NOT blank))::DOUBLE AS n2, sum(mid) FILTER (blank) AS r1, median({c}) FILTER (blank) AS hi, median({c}) FILTER (NOT blank) AS lo,
            (SELECT sum(k ** 3 - k) FROM (SELECT count(*)::DOUBLE AS k FROM g GROUP BY {c})) AS ties FROM (SELECT *, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS mid FROM g)))"""


def _crossed(c: str, step: float) -> str:
    return f"""(SELECT '{c}', 'label', sum(greatest(abs(b - c * nb / n) - {step}, 0) ** 2 / (c * nb / n) + greatest(abs(c - b - c * (n - nb) / n) - {step}, 0) ** 2 / (c * (n - nb) / n)), max(b / c), min(b / c), arg_max({c}, (b / c, {c})) FROM (
        SELECT {c}, count(*)::DOUBLE AS c, (count(*) FILTER (blank))::DOUBLE AS b FROM g GROUP BY 1), (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (blank))::DOUBLE AS nb FROM g))"""


@query(f"""WITH {GAPS}, a AS ({_ranked('o_totalprice')} UNION ALL {_ranked('o_custkey')} UNION ALL {_crossed('o_orderpriority', 0)} UNION ALL {_crossed('size', 0.5)})
    SELECT driver, kind, round(statistic, 6) AS statistic, statistic > CASE driver WHEN 'size' THEN {BEYOND['one']} WHEN 'o_orderpriority' THEN {BEYOND['four']} ELSE {BEYOND['z']} END AS drives, round(high, 6) AS high, round(low, 6) AS low, label FROM a""")
def missing_drivers(t):
    """What blanks depend on, at one level for all candidates together."""
    return r(S.missing_drivers(gaps(t), "score").drop("p"), 6, "statistic", "high", "low")


def _simpson(by: str) -> str:
    return f"""(WITH o AS (SELECT l_returnflag AS c, avg(l_quantity) AS m FROM lineitem GROUP BY 1), e AS (SELECT arg_max(c, m) AS winner, arg_min(c, m) AS loser FROM o),
        p AS (SELECT CAST({by} AS VARCHAR) AS label, count(*) AS n, avg(l_quantity) FILTER (l_returnflag = winner) AS w, avg(l_quantity) FILTER (l_returnflag = loser) AS l, any_value(winner) AS winner, any_value(loser) AS loser FROM lineitem, e GROUP BY 1)
        SELECT '{by}' AS "by", label, n, winner, loser, round(w, 6) AS winner_rate, round(l, 6) AS loser_rate, l > w AS reversed,
            CASE WHEN count(*) OVER () < 2 THEN 'unchecked' WHEN count(*) FILTER (l > w) OVER () = count(*) OVER () THEN 'paradox' WHEN count(*) FILTER (l > w) OVER () > 0 THEN 'reverses' ELSE 'holds' END AS verdict FROM p WHERE n >= 30 AND w IS NOT NULL AND l IS NOT NULL)"""


@query(f"{_simpson('l_linestatus')} UNION ALL {_simpson('l_linenumber')}")
def simpson(t):
    """Whether the flag of the largest mean quantity also wins inside every status and every line number."""
    return r(S.simpson(t("lineitem"), "l_quantity", "l_returnflag", ["l_linestatus", "l_linenumber"]), 6, "winner_rate", "loser_rate")
