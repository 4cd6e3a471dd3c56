"""Grouping, ranking, pivots, grain, reconciliation and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import join as J
from . import query


def r(df, digits=4, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


KEYED = "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS k FROM customer"


@query(f"""SELECT 'blank keys' AS flag UNION ALL SELECT 'whitespace' WHERE (SELECT avg(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) FROM orders WHERE o_orderkey % 10 <> 3) > 0.01
    UNION ALL SELECT 'zero padding' WHERE (SELECT avg(CASE WHEN k LIKE '0%' THEN 1 ELSE 0 END) FROM ({KEYED})) > 0.2
    UNION ALL SELECT 'rows lost' WHERE EXISTS (SELECT * FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 10 = 3)""")
def join_card(t):
    """The card of a join whose text keys are padded on one side, blank or with outer blanks on the other."""
    customers = t("customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("k"), "c_name").union(t("customer").select(F.col("c_custkey").cast("string"), "c_name").limit(0))
    plain = F.col("o_custkey").cast("string")
    orders = t("orders").select(F.when(F.col("o_orderkey") % 10 == 3, None).when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" "), plain)).when(F.col("o_orderkey") % 40 == 1, F.lpad(plain, 8, "0")).otherwise(plain).alias("k"), "o_totalprice")
    card = J.forecast(orders, customers, [("k", "k")], "inner")
    keep = [x for x in card.flags if x in ("blank keys", "whitespace", "zero padding", "rows lost", "type mismatch", "case")]
    return t("orders").sparkSession.createDataFrame([(x,) for x in keep], "flag string")


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_custkey), 4) AS o_custkey_mean, count(*) AS n_rows FROM orders GROUP BY 1")
def group_agg_nrows(t):
    out = A.group_dataset(t("orders"), ["o_orderpriority"], {"o_totalprice": "sum", "o_custkey": "mean"})
    return r(r(out, 2, "o_totalprice_sum"), 4, "o_custkey_mean")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def group_distinct_keys(t):
    return A.group_dataset(t("lineitem"), ["l_returnflag", "l_linestatus"])


def _rank_sql(value: str, table: str, group: str, order: str = "DESC", shares: bool = False, top: int | None = None) -> str:
    more = ", round(100 * value / sum(value) OVER (), 4) AS share_pct, round(100 * sum(value) OVER (ORDER BY value DESC, label) / sum(value) OVER (), 4) AS cumulative_pct" if shares else ""
    sql = f"""WITH g AS (SELECT CAST({group} AS VARCHAR) AS label, CAST({value} AS DOUBLE) AS value FROM {table} GROUP BY 1),
        k AS (SELECT label, value, CAST(row_number() OVER (ORDER BY value {order}, label) AS INTEGER) AS rank{more} FROM g)
        SELECT label, round(value, 2) AS value, rank{', share_pct, cumulative_pct' if shares else ''} FROM k"""
    return sql + (f" WHERE rank <= {top}" if top else "")


@query(_rank_sql("sum(o_totalprice)", "orders", "o_orderpriority", shares=True))
def rank_sum(t):
    return r(r(A.rank_by(t("orders"), "o_orderpriority", "o_totalprice"), 2, "value"), 4, "share_pct", "cumulative_pct")


@query(_rank_sql("avg(o_totalprice)", "orders", "o_orderpriority"))
def rank_mean(t):
    return r(A.rank_by(t("orders"), "o_orderpriority", "o_totalprice", "mean"), 2, "value")


@query(_rank_sql("median(l_extendedprice)", "lineitem", "l_returnflag"))
def rank_median(t):
    return r(A.rank_by(t("lineitem"), "l_returnflag", "l_extendedprice", "median"), 2, "value")


@query(_rank_sql("count(*)", "events", "event_type", shares=True))
def rank_count(t):
    return r(A.rank_by(t("events"), "event_type"), 4, "share_pct", "cumulative_pct")


@query(_rank_sql("sum(l_quantity)", "lineitem", "l_suppkey", order="ASC", top=10))
def rank_ascending(t):
    return r(A.rank_by(t("lineitem"), "l_suppkey", "l_quantity", top=10, ascending=True), 2, "value").drop("share_pct", "cumulative_pct")


@query("""WITH g AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1), k AS (SELECT v, row_number() OVER (ORDER BY v DESC, CAST(o_custkey AS VARCHAR)) AS rank FROM g),
    p AS (SELECT max(v) FILTER (rank = 5) AS inside, max(v) FILTER (rank = 6) AS outside FROM k)
    SELECT round(inside, 2) AS inside, round(outside, 2) AS outside, round(abs(inside - outside) / abs(inside), 6) AS gap, abs(inside - outside) / abs(inside) < 0.05 AS tie FROM p""")
def rank_near_tie(t):
    return r(r(A.near_tie(A.rank_by(t("orders"), "o_custkey", "o_totalprice"), 5), 2, "inside", "outside"), 6, "gap")


@query("""WITH c AS (SELECT o_orderpriority, count(*) AS c FROM orders GROUP BY 1)
    SELECT count(*) AS groups, CAST(sum(c) AS BIGINT) AS n, round(sum(CAST(c AS DOUBLE) * c) * count(*) / sum(c) - sum(c), 6) AS statistic, count(*) - 1 AS dof FROM c""")
def rank_chi2_uniform(t):
    return r(A.uniformity(t("orders"), "o_orderpriority"), 6, "statistic")


@query("SELECT p_name, count(DISTINCT p_partkey) AS n_ids, count(*) AS n_rows FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def label_collisions(t):
    return A.label_collisions(t("part"), "p_name", "p_partkey")


@query("""SELECT l_returnflag, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0), 2) AS "F", round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0), 2) AS "O" FROM lineitem GROUP BY 1""")
def pivot_sum(t):
    return r(A.pivot_dataset(t("lineitem"), ["l_returnflag"], ["l_linestatus"], "l_quantity", column_levels=["F", "O"]), 2, "F", "O")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def pivot_count(t):
    return A.pivot_dataset(t("orders"), ["o_orderpriority"], ["o_orderstatus"], column_levels=["F", "O", "P"])


@query("""WITH p AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, sum(count(*)) OVER () AS n FROM orders GROUP BY 1)
    SELECT o_orderpriority, round(100.0 * f / n, 2) AS "F", round(100.0 * o / n, 2) AS "O", round(100.0 * p / n, 2) AS "P" FROM p""")
def pivot_percent(t):
    return A.pivot_dataset(t("orders"), ["o_orderpriority"], ["o_orderstatus"], percent=True, column_levels=["F", "O", "P"])


@query("SELECT event_type, CAST(user_id % 10 AS INTEGER) AS digit, count(*) AS n_rows, count(DISTINCT event_type || ':' || user_id % 10) AS pair_nunique FROM events GROUP BY 1, 2")
def crosstab(t):
    e = t("events").withColumn("digit", (F.col("user_id") % 10).cast("int")).withColumn("pair", F.concat_ws(":", "event_type", "digit"))
    return A.group_dataset(e, ["event_type", "digit"], {"pair": "nunique"})


@query("""WITH a AS (SELECT sum(o_totalprice) AS actual FROM orders)
    SELECT round(actual, 2) AS actual, CAST(1000000 AS DOUBLE) AS expected, round(actual - 1000000, 2) AS gap, round(abs(actual - 1000000) / 1000000, 6) AS relative_gap, abs(actual - 1000000) / 1000000 <= 0.005 AS matches FROM a""")
def reconcile_sum(t):
    return r(r(A.reconcile(t("orders"), "o_totalprice", 1_000_000), 2, "actual", "gap"), 6, "relative_gap")


@query("""WITH a AS (SELECT count(DISTINCT user_id) AS actual FROM events)
    SELECT CAST(actual AS DOUBLE) AS actual, CAST(150 AS DOUBLE) AS expected, CAST(actual - 150 AS DOUBLE) AS gap, round(abs(actual - 150) / 150, 6) AS relative_gap, abs(actual - 150) / 150 <= 0.005 AS matches FROM a""")
def reconcile_nunique(t):
    return r(A.reconcile(t("events"), "user_id", 150, "nunique"), 6, "relative_gap")


@query("""WITH n AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS a, count(DISTINCT o_custkey) AS b, count(DISTINCT o_totalprice) AS c, count(DISTINCT o_orderstatus) AS d FROM orders),
    x AS (SELECT 'o_orderkey' AS "column", a AS n_distinct, a / n AS uniqueness, true AS named FROM n UNION ALL SELECT 'o_custkey', b, b / n, true FROM n UNION ALL SELECT 'o_totalprice', c, c / n, false FROM n UNION ALL SELECT 'o_orderstatus', d, d / n, false FROM n)
    SELECT "column", n_distinct, round(uniqueness, 6) AS uniqueness, named FROM x WHERE named OR uniqueness >= 0.9""")
def grain_candidates(t):
    return r(A.grain_candidates(t("orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]), 6, "uniqueness")


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT count(*) AS n_keys, count(*) FILTER (n > 1) AS repeated_keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM k""")
def grain_violations(t):
    return A.grain_violations(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem),
    s AS (SELECT 'l_quantity' AS measure, sum(l_quantity) AS as_is, sum(l_quantity) FILTER (k = 1) AS once FROM f UNION ALL SELECT 'l_extendedprice', sum(l_extendedprice), sum(l_extendedprice) FILTER (k = 1) FROM f)
    SELECT measure, round(as_is, 2) AS as_is, round(once, 2) AS once, round(as_is - once, 2) AS excess FROM s""")
def grain_measure_cost(t):
    out = A.grain_measure_cost(t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], ["l_quantity", "l_extendedprice"])
    return r(out, 2, "as_is", "once", "excess")


@query("""WITH k AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linestatus) AS b FROM lineitem GROUP BY 1 HAVING count(*) > 1)
    SELECT 'l_returnflag' AS "column", count(*) FILTER (a > 1) AS conflicting_keys FROM k UNION ALL SELECT 'l_linestatus', count(*) FILTER (b > 1) FROM k""")
def grain_conflicts(t):
    return A.conflicting_columns(t("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), ["l_orderkey"])


@query("""SELECT o_orderpriority, round(avg(CASE WHEN o_orderkey % 7 = 0 THEN 1.0 ELSE 0 END), 6) AS share, count(*) AS n_rows, CASE WHEN avg(CASE WHEN o_orderkey % 7 = 0 THEN 1.0 ELSE 0 END) >= 0.5 THEN 'mostly' ELSE 'no' END AS imputed FROM orders GROUP BY 1""")
def imputed_group_share(t):
    marked = t("orders").withColumn("o_totalprice_was_missing", (F.col("o_orderkey") % 7 == 0).cast("int"))
    return r(A.imputed_share(marked, "o_orderpriority", "o_totalprice_was_missing"), 6, "share")


# Joins. Orders meet customers under twice their key, so that both sides have orphans.
EVEN = "(SELECT 2 * c_custkey AS o_custkey, c_mktsegment FROM customer)"


def _sides(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), t("customer").select((2 * F.col("c_custkey")).alias("o_custkey"), "c_mktsegment")


def _join_sql(kind: str) -> str:
    return f"SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) {kind} JOIN {EVEN} USING (o_custkey)"


@query(_join_sql("INNER"))
def join_inner(t):
    return J.join_datasets(*_sides(t), [("o_custkey", "o_custkey")], "inner")


@query(_join_sql("LEFT"))
def join_left(t):
    return J.join_datasets(*_sides(t), [("o_custkey", "o_custkey")], "left")


@query(_join_sql("RIGHT"))
def join_right(t):
    return J.join_datasets(*_sides(t), [("o_custkey", "o_custkey")], "right")


@query(_join_sql("FULL"))
def join_outer(t):
    return J.join_datasets(*_sides(t), [("o_custkey", "o_custkey")], "outer")


@query("""WITH a AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), b AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
    SELECT l_partkey, l_suppkey, round(a.q, 2) AS q_left, round(b.q, 2) AS q_right FROM a JOIN b USING (l_partkey, l_suppkey)""")
def join_composite(t):
    side = lambda f: t("lineitem").filter(F.col("l_returnflag") == f).groupBy("l_partkey", "l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return J.join_datasets(side("R"), side("A"), [("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey")], "inner")


NULLED = "SELECT CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_nationkey END AS k, s_suppkey FROM supplier"


@query(f"""WITH a AS ({NULLED}), b AS (SELECT k, count(*) AS suppliers FROM a GROUP BY 1) SELECT a.k, a.s_suppkey, b.suppliers FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_safe(t):
    a = t("supplier").select(F.when(F.col("s_suppkey") % 10 != 0, F.col("s_nationkey")).alias("k"), "s_suppkey")
    return J.join_datasets(a, a.groupBy("k").agg(F.count("*").alias("suppliers")), [("k", "k")], "inner").select("k", "s_suppkey", "suppliers")


@query("SELECT c_custkey, count(o_orderkey) AS matches FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def match_counts(t):
    return J.match_counts(t("customer").select("c_custkey"), t("orders"), [("c_custkey", "o_custkey")])


@query(f"""WITH l AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT o_custkey, count(*) AS n FROM {EVEN} GROUP BY 1),
    j AS (SELECT coalesce(l.n, 0) AS a, coalesce(r.n, 0) AS b FROM l FULL JOIN r USING (o_custkey))
    SELECT CAST(sum(a * b) AS BIGINT) AS inner_rows, CAST(sum(a * greatest(b, 1)) AS BIGINT) AS left_rows, CAST(sum(CASE WHEN b = 0 THEN a ELSE 0 END) AS BIGINT) AS left_orphans, CAST(sum(a) AS BIGINT) AS n_left,
    CAST(sum(b * greatest(a, 1)) AS BIGINT) AS right_rows, CAST(sum(CASE WHEN a = 0 THEN b ELSE 0 END) AS BIGINT) AS right_orphans, CAST(sum(b) AS BIGINT) AS n_right,
    CAST(sum(a * greatest(b, 1)) + sum(CASE WHEN a = 0 THEN b ELSE 0 END) AS BIGINT) AS outer_rows FROM j""")
def join_forecast_rows(t):
    return J.forecast_rows(*_sides(t), [("o_custkey", "o_custkey")])


@query("""SELECT 'o_totalprice' AS measure, round(sum(o_totalprice), 2) AS before, round(sum(o_totalprice) FILTER (o_custkey IN (SELECT 2 * c_custkey FROM customer)), 2) AS after, round(sum(o_totalprice) FILTER (NOT o_custkey IN (SELECT 2 * c_custkey FROM customer)), 2) AS lost FROM orders""")
def measure_impact(t):
    return r(J.measure_impact(*_sides(t), [("o_custkey", "o_custkey")], ["o_totalprice"]), 2, "before", "after", "lost")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT o_custkey IN (SELECT 2 * c_custkey FROM customer)")
def left_orphans(t):
    return J.orphans(*_sides(t), [("o_custkey", "o_custkey")])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def right_orphans(t):
    return J.orphans(t("customer").select("c_custkey"), t("orders"), [("c_custkey", "o_custkey")])


@query("SELECT count(*) = count(DISTINCT o_custkey) AS left_unique, true AS right_unique, 'n-1' AS relationship FROM orders")
def key_relationship(t):
    return J.key_relationship(t("orders"), t("customer"), [("o_custkey", "c_custkey")])


PADDED = "CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN c_custkey % 5 = 0 THEN c_custkey || ' ' ELSE CAST(c_custkey AS VARCHAR) END"


@query(f"""WITH k AS (SELECT {PADDED} AS k FROM customer) SELECT round(avg(CASE WHEN regexp_full_match(k, '0[0-9]+') THEN 1.0 ELSE 0 END), 6) AS padded_share, round(avg(CASE WHEN k <> trim(k) THEN 1.0 ELSE 0 END), 6) AS untrimmed_share, count(*) FILTER (trim(k) = '') AS blank_keys FROM k""")
def key_padding_share(t):
    c = F.col("c_custkey")
    k = F.when(c % 3 == 0, F.lpad(c.cast("string"), 8, "0")).when(c % 5 == 0, F.concat(c.cast("string"), F.lit(" "))).otherwise(c.cast("string"))
    return r(J.key_problems(t("customer").select(k.alias("k")), "k"), 6, "padded_share", "untrimmed_share")


@query("""WITH a AS (SELECT DISTINCT c_mktsegment AS k FROM customer), b AS (SELECT DISTINCT CASE WHEN c_mktsegment < 'C' THEN c_mktsegment ELSE lower(c_mktsegment) END AS k FROM customer)
    SELECT count(*) AS n_keys, count(*) FILTER (k IN (SELECT k FROM b)) AS exact, count(*) FILTER (k NOT IN (SELECT k FROM b) AND lower(k) IN (SELECT lower(k) FROM b)) AS case_only FROM a""")
def key_case_overlap(t):
    c = t("customer")
    other = c.select(F.when(F.col("c_mktsegment") < "C", F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("k"))
    return J.case_only_overlap(c, other, ("c_mktsegment", "k"))


@query("""WITH j AS (SELECT c_mktsegment AS label, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT label, round(value, 2) AS value, CAST(row_number() OVER (ORDER BY value DESC, label) AS INTEGER) AS rank, round(100 * value / sum(value) OVER (), 4) AS share_pct, round(100 * sum(value) OVER (ORDER BY value DESC, label) / sum(value) OVER (), 4) AS cumulative_pct FROM j""")
def flagship(t):
    """Orders meet customers, once the forecast shows that no row or measure is lost; segments are ranked."""
    orders, customers = t("orders").select("o_custkey", "o_totalprice"), t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    keys = [("o_custkey", "o_custkey")]
    card = J.forecast(orders, customers, keys, "inner")
    if not card:
        raise ValueError(card.reason)
    joined = J.join_datasets(orders, customers, keys, "inner")
    return r(r(A.rank_by(joined, "c_mktsegment", "o_totalprice"), 2, "value"), 4, "share_pct", "cumulative_pct")
