"""Cleaning steps on orders with holes, spoilt labels and outliers, made the same way in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cleaning as C
from . import query
from .relational import r

K = "o_orderkey"
HOLES = f"SELECT {K}, o_orderpriority, CASE WHEN {K} % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN {K} % 5 <> 0 THEN o_orderstatus END AS status FROM orders"


def holes(t):
    k = F.col(K)
    return t("orders").select(K, "o_orderpriority", F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("status"))


@query(f"SELECT {K}, CAST(price IS NULL AS INTEGER) AS price_was_missing FROM ({HOLES})")
def flag_missing(t):
    return C.flag_missing(holes(t), ["price"]).select(K, "price_was_missing")


def _impute_sql(value: str) -> str:
    return f"WITH h AS ({HOLES}) SELECT {K}, round(coalesce(price, (SELECT {value} FROM h)), 4) AS price FROM h"


@query(_impute_sql("median(price)"))
def impute_median(t):
    return r(C.impute(holes(t), ["price"]), 4, "price").select(K, "price")


@query(_impute_sql("avg(price)"))
def impute_mean(t):
    return r(C.impute(holes(t), ["price"], "mean"), 4, "price").select(K, "price")


@query(f"WITH h AS ({HOLES}) SELECT {K}, coalesce(status, (SELECT status FROM h WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, status LIMIT 1)) AS status FROM h")
def impute_mode(t):
    return C.impute(holes(t), ["status"], "mode").select(K, "status")


@query(f"SELECT {K}, coalesce(status, 'Unknown') AS status, coalesce(price, 0) AS price FROM ({HOLES})")
def impute_constant(t):
    return C.impute(holes(t), ["status", "price"], "constant").select(K, "status", "price")


@query(f"WITH h AS ({HOLES}), g AS (SELECT o_orderpriority, median(price) AS m FROM h GROUP BY 1) SELECT {K}, round(coalesce(price, m), 4) AS price FROM h JOIN g USING (o_orderpriority)")
def impute_by_group(t):
    return r(C.impute(holes(t), ["price"], by=["o_orderpriority"]), 4, "price").select(K, "price")


@query(f"SELECT {K}, last_value(price IGNORE NULLS) OVER (PARTITION BY o_orderpriority ORDER BY {K}) AS price FROM ({HOLES})")
def ffill(t):
    return C.ffill(holes(t), "price", K, ["o_orderpriority"]).select(K, "price")


@query(f"SELECT {K}, first_value(price IGNORE NULLS) OVER (PARTITION BY o_orderpriority ORDER BY {K} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price FROM ({HOLES})")
def bfill(t):
    return C.bfill(holes(t), "price", K, ["o_orderpriority"]).select(K, "price")


@query(f"""WITH n AS (SELECT *, row_number() OVER w AS p FROM ({HOLES}) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY {K})), k AS (SELECT *, CASE WHEN price IS NOT NULL THEN p END AS q FROM n),
    s AS (SELECT *, last_value(price IGNORE NULLS) OVER b AS a, last_value(q IGNORE NULLS) OVER b AS i, first_value(price IGNORE NULLS) OVER f AS z, first_value(q IGNORE NULLS) OVER f AS j FROM k WINDOW b AS (PARTITION BY o_orderpriority ORDER BY {K}), f AS (PARTITION BY o_orderpriority ORDER BY {K} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT {K}, round(coalesce(price, CASE WHEN j > i THEN a + (z - a) * (p - i) / (j - i) END, a, z), 4) AS price FROM s""")
def interpolate(t):
    return r(C.interpolate(holes(t), "price", K, ["o_orderpriority"]), 4, "price").select(K, "price")


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedup_exact(t):
    return C.deduplicate(t("lineitem").select("l_orderkey", "l_linenumber"))


SPOILT = "CASE c_custkey % 4 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN lower(c_mktsegment) || '.' WHEN 2 THEN '  ' || c_mktsegment || chr(9) ELSE c_mktsegment END"


def spoilt(t):
    k, s = F.col("c_custkey") % 4, F.col("c_mktsegment")
    label = F.when(k == 0, F.upper(s)).when(k == 1, F.concat(F.lower(s), F.lit("."))).when(k == 2, F.concat(F.lit("  "), s, F.lit("\t"))).otherwise(s)
    return t("customer").select("c_custkey", label.alias("segment"))


@query(f"SELECT count(*) AS n_rows, count(*) - count(DISTINCT trim(regexp_replace(regexp_replace(lower({SPOILT}), '[^\\w\\s]+', '', 'g'), '\\s+', ' ', 'g'))) AS n_duplicates FROM customer")
def dedup_normalised_count(t):
    return C.normalised_duplicates(spoilt(t).select("segment"), ["segment"])


@query(f"SELECT c_custkey, trim({SPOILT}, ' ' || chr(9)) AS segment FROM customer")
def trim_text(t):
    return C.trim_text(spoilt(t), ["segment"])


@query("SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer")
def normalize_case(t):
    return C.normalize_case(t("customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), ["segment"])


@query("SELECT c_custkey, regexp_replace(c_name || ' & co', ' {2,}', ' ', 'g') AS name FROM customer")
def fix_syntax(t):
    return C.fix_syntax(t("customer").select("c_custkey", F.concat("c_name", F.lit("  &amp;  co\x07")).alias("name")), ["name"])


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS kind, substr(c_name, instr(c_name, '#') + 1) AS number FROM customer WHERE contains(c_name, '#') UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE NOT contains(c_name, '#')")
def split_column(t):
    return C.split_column(t("customer").select("c_custkey", "c_name"), "c_name", "#", ("kind", "number"))


@query(f"SELECT {K}, CASE WHEN {K} % 11 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS price FROM orders")
def cast_types(t):
    raw = F.when(F.col(K) % 11 == 0, "n/a").otherwise(F.concat(F.lit(" $"), F.format_number("o_totalprice", 2)))
    return C.cast_types(t("orders").select(K, raw.alias("price")), ["price"])


@query(f"SELECT {K}, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
def parse_years(t):
    return C.parse_years(t("orders").select(K, F.concat(F.lit("("), F.year("o_orderdate").cast("string"), F.lit("– )")).alias("y")), ["y"])


@query(f"SELECT {K}, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def uniform_dates(t):
    return C.uniform_dates(t("orders").select(K, F.date_format("o_orderdate", "d/M/yyyy").alias("d")), "d")


@query(f"SELECT {K}, CASE {K} % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'maybe' END AS flag, {K} % 2 = 0 AS known FROM orders")
def convert_booleans(t):
    """A column with another word stays text; one without becomes boolean."""
    k = F.col(K) % 3
    return C.convert_booleans(t("orders").select(K, F.when(k == 0, " Yes").when(k == 1, "F").otherwise("maybe").alias("flag"), F.when(F.col(K) % 2 == 0, "t").otherwise("NO ").alias("known")), ["flag", "known"])


@query("SELECT p_partkey, CAST(p_size * 2.54 AS DOUBLE) AS size FROM part")
def harmonize_units(t):
    return r(C.harmonize_units(t("part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(" inch")).alias("size")), "size", 2.54), 6, "size")


@query(f"SELECT {K}, least(greatest(price, 20000), 200000) AS price, CAST(coalesce(price < 20000 OR price > 200000, false) AS INTEGER) AS price_was_capped FROM ({HOLES}) WHERE price IS NOT NULL UNION ALL SELECT {K}, NULL, 0 FROM ({HOLES}) WHERE price IS NULL")
def cap_outliers_clip(t):
    return C.cap_outliers(holes(t), "price", 20_000.0, 200_000.0).select(K, "price", "price_was_capped")


@query(f"SELECT {K}, CASE WHEN price BETWEEN 20000 AND 200000 THEN price END AS price, CAST(coalesce(price < 20000 OR price > 200000, false) AS INTEGER) AS price_was_capped FROM ({HOLES})")
def cap_outliers_null(t):
    return C.cap_outliers(holes(t), "price", 20_000.0, 200_000.0, "null").select(K, "price", "price_was_capped")


@query(f"""WITH s AS (SELECT c_custkey, {SPOILT} AS segment FROM customer), n AS (SELECT segment, count(*) AS n, trim(regexp_replace(regexp_replace(lower(segment), '[^\\w\\s]+', '', 'g'), '\\s+', ' ', 'g')) AS k FROM s GROUP BY 1),
    b AS (SELECT segment, first_value(segment) OVER (PARTITION BY k ORDER BY n DESC, segment) AS best FROM n) SELECT c_custkey, best AS segment FROM s JOIN b USING (segment)""")
def standardize_categories(t):
    return C.standardize_categories(spoilt(t), "segment")


@query("SELECT c_custkey, c_mktsegment || ' corp' AS firm FROM customer")
def fuzzy_merge_entity(t):
    k, s = F.col("c_custkey") % 10, F.col("c_mktsegment")
    return C.fuzzy_merge(t("customer").select("c_custkey", F.when(k < 1, F.concat(s, F.lit(" Corporation"))).otherwise(F.concat(s, F.lit(" corp"))).alias("firm")), "firm")


@query()
def fuzzy_merge_similar(t):
    """Some parts' names lack a letter; the choice among similar labels is greedy, which SQL does not express."""
    name = F.when(F.col("p_partkey") % 10 == 0, F.expr("left(p_name, length(p_name) - 1)")).otherwise(F.col("p_name"))
    return C.fuzzy_merge(t("part").select("p_partkey", F.concat(name, F.lit(" "), "p_brand").alias("label")), "label", 0.95)


@query("SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate, CASE WHEN l_shipdate < o_orderdate THEN 0 ELSE 1 END AS l_shipdate_vs_o_orderdate_valid FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def cross_field(t):
    both = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate")
    return C.cross_field(both, "o_orderdate", "l_shipdate")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS mail_valid FROM customer")
def rule_validate_email(t):
    k = F.col("c_custkey")
    mail = F.when(k % 3 == 0, F.concat(F.lit("user"), k.cast("string"), F.lit("(at)example"))).otherwise(F.concat(F.lit(" user"), k.cast("string"), F.lit("@example.com")))
    return C.rule_validate(t("customer").select("c_custkey", mail.alias("mail")), "mail", text.EMAIL).drop("mail")


@query(f"SELECT {K}, price, status FROM ({HOLES}) WHERE (CASE WHEN price IS NULL THEN 1 ELSE 0 END) + (CASE WHEN status IS NULL THEN 1 ELSE 0 END) < 2")
def drop_sparse_rows(t):
    return C.drop_sparse_rows(holes(t).select(K, "price", "status"), 0.6)


@query(f"SELECT {K} FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'")
def filter_date_range(t):
    return C.filter_date_range(t("orders"), "o_orderdate", "1996-01-01", "1996-12-31").select(K)


@query("""WITH a AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, avg(least(o_totalprice, 150000)) AS n FROM orders)
    SELECT 'o_totalprice' AS "column", round(m, 4) AS before, round(n, 4) AS after, round(abs(n - m) / s, 6) AS shift, abs(n - m) / s >= 0.25 AS marked FROM a""")
def drift_report(t):
    o = t("orders")
    out = C.drift_report(o, o.withColumn("o_totalprice", F.least("o_totalprice", F.lit(150_000.0))), ["o_totalprice"])
    return r(r(out, 4, "before", "after"), 6, "shift")


@query("""WITH p AS (SELECT exp(o_totalprice / 40000) AS v FROM orders), x AS (SELECT v, log10(v) AS l FROM p), q AS (SELECT quantile_cont(v, 0.25) AS a, median(v) AS m, quantile_cont(v, 0.75) AS b, quantile_cont(l, 0.25) AS c, quantile_cont(l, 0.75) AS d FROM x),
    s AS (SELECT count(*) AS n, count(DISTINCT v) AS levels, max(v) / max(m) AS reach, avg(CASE WHEN v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) THEN 1.0 ELSE 0 END) AS raw_share, avg(CASE WHEN l < c - 1.5 * (d - c) OR l > d + 1.5 * (d - c) THEN 1.0 ELSE 0 END) AS log_share FROM x, q)
    SELECT n, levels, round(reach, 3) AS reach, round(raw_share, 6) AS raw_share, round(log_share, 6) AS log_share, n >= 8 AND levels >= 5 AND reach >= 50 AND raw_share > 0.02 AND log_share < raw_share / 2 AS heavy FROM s""")
def heavy_tail_test(t):
    return r(r(C.heavy_tail(t("orders").select(F.exp(F.col("o_totalprice") / 40_000).alias("v")), "v"), 3, "reach"), 6, "raw_share", "log_share")
