"""The ledger, claims held against it, reports and sources."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..ledger import EvidenceLedger
from ..operators import aggregate as A
from ..operators import claims
from ..operators import pairings as P
from ..operators import report as R
from ..plans import cleaning as plan
from ..session import EngineSession
from ..sources import tables
from . import query
from .relational import r


def ledger_of(t) -> EvidenceLedger:
    """The session's ledger after one ranking of priorities by value."""
    led = EvidenceLedger()
    ranked = A.rank_by(t("orders"), "o_orderpriority", "o_totalprice").orderBy("rank").collect()  # a row per priority
    led.note_ranking("orders", "o_orderpriority", "o_totalprice", "sum", [(x["label"], x["value"]) for x in ranked])
    return led


RANKED = "SELECT o_orderpriority AS label, sum(o_totalprice) AS value, CAST(row_number() OVER (ORDER BY sum(o_totalprice) DESC) AS INTEGER) AS rank FROM orders GROUP BY 1"


@query(f"SELECT 'orders' AS dataset, 'o_orderpriority' AS group_col, 'o_totalprice' AS value_col, 'sum' AS how, rank, label, round(value, 2) AS value FROM ({RANKED})")
def ledger_rankings(t):
    return r(ledger_of(t).rankings_table(t("orders").sparkSession), 2, "value")


@query(f"SELECT label || ' ranks ' || rank || ', not within 2' AS finding FROM ({RANKED}) WHERE rank > 2")
def claim_top_n(t):
    led = ledger_of(t)
    names = ", ".join(label for label, _ in led.rankings[0]["order"])
    found = claims.check_top_n(f"The top 2 are {names}.", led)
    return t("orders").sparkSession.createDataFrame([(x,) for x in found], "finding string")


@query(f"SELECT 'the top 20 % make ' || CAST(round(100 * max(value) / sum(value)) AS INTEGER) || ' %, not 80 %' AS finding FROM ({RANKED})")
def claim_share(t):
    found = claims.check_share("The top 20 % of priorities make 80 % of value.", ledger_of(t))
    return t("orders").sparkSession.createDataFrame([(x,) for x in found], "finding string")


@query("""WITH c AS (SELECT c_mktsegment AS a, n_name AS b, CAST(count(*) AS DOUBLE) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY v DESC, b) AS INTEGER) AS place, count(*) OVER (PARTITION BY a) AS levels FROM c)
    SELECT a, b, v, place, levels, place > greatest(3, floor((levels + 1) / 2)) AS laggard FROM p WHERE levels >= 3""")
def pairing_laggards(t):
    both = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return claims.pairing_laggards(both, "c_mktsegment", "n_name")


@query(f"SELECT 'o_orderpriority' AS dimension, label AS leader, round(value, 2) AS value, round(100 * value / (SELECT sum(value) FROM ({RANKED})), 4) AS share_pct FROM ({RANKED}) WHERE rank = 1")
def kpi_rows(t):
    return r(r(R.kpi_rows(ledger_of(t), t("orders").sparkSession), 2, "value"), 4, "share_pct")


@query("""WITH g AS (SELECT sum(n - 1) AS extra FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) SELECT 'grain' AS kind, 'lineitem repeats l_orderkey: ' || extra || ' extra rows' AS sentence FROM g WHERE extra > 0
    UNION ALL SELECT 'marker', 'tax_was_missing holds in ' || printf('%.1f', 100 * avg(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END)) || ' % of rows' FROM lineitem""")
def limitations(t):
    s = EngineSession(t("orders").sparkSession)
    s.catalog.register("lineitem", t("lineitem").withColumn("tax_was_missing", (F.col("l_linenumber") == 3).cast("int")), "parquet:lineitem")
    s.check_grain("lineitem", ["l_orderkey"])
    return R.limitations(s, "lineitem")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_csv_roundtrip(t):
    df = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    path = f"{base}/roundtrip-{abs(hash(str(df.inputFiles()[:1])))}.csv"
    tables.save(df, path)
    return tables.load_csv(df.sparkSession, path, schema=df.schema)


@query("SELECT 'customer' AS name, 'parquet:customer' AS source, (SELECT count(*) FROM customer) AS n_rows, CAST(5 AS INTEGER) AS n_columns UNION ALL SELECT 'orders', 'parquet:orders', (SELECT count(*) FROM orders), 6")
def list_datasets(t):
    s = EngineSession(t("orders").sparkSession)
    for name in ("orders", "customer"):
        s.catalog.register(name, t(name), f"parquet:{name}")
    return s.catalog.listing()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey, o_totalprice LIMIT 10")
def preview(t):
    return tables.preview(t("orders").select("o_orderkey", "o_totalprice"), 10, ["o_orderkey", "o_totalprice"])


@query("""WITH h AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status FROM orders), n AS (SELECT count(*) - count(price) AS price, count(*) - count(status) AS status FROM h)
    SELECT 'impute' AS action, 'price' AS "column" FROM n WHERE price > 0 UNION ALL SELECT 'impute', 'status' FROM n WHERE status > 0""")
def diagnose_plan(t):
    from .cleaning import holes

    ops = [o for o in plan.diagnose(holes(t)) if o.action == "impute"]
    return t("orders").sparkSession.createDataFrame([(o.action, o.columns[0]) for o in ops], "action string, column string")


@query("""WITH h AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status FROM orders)
    SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM h)), 4) AS price, coalesce(status, (SELECT status FROM h WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, status LIMIT 1)) AS status FROM h""")
def replay_plan(t):
    from .cleaning import holes

    df = holes(t)
    ops = [o for o in plan.diagnose(df) if o.action == "impute"]
    return r(plan.replay(df, plan.manifest(ops))[0], 4, "price").select("o_orderkey", "price", "status")


@query("SELECT 'o_totalprice' AS \"column\", 'double' AS dtype, count(o_totalprice) AS filled, count(DISTINCT o_totalprice) AS n_distinct FROM orders UNION ALL SELECT 'o_orderstatus', 'string', count(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders")
def column_summary(t):
    return R.column_summary(t("orders").select("o_totalprice", "o_orderstatus"))


@query("""SELECT 'source' AS step, 'orders comes from parquet:orders, 6 columns' AS sentence UNION ALL SELECT 'source', 'customer comes from parquet:customer, ' || (SELECT count(*) FROM (DESCRIBE customer)) || ' columns'
    UNION ALL SELECT 'source', 'both comes from join:orders+customer, ' || ((SELECT count(*) FROM (DESCRIBE customer)) + 6) || ' columns'
    UNION ALL SELECT 'join', 'both is the left join of orders and customer, ' || (SELECT count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey) || ' rows; 0 rows of orders found no partner'""")
def provenance(t):
    """How a joined table was built, after a join that was forecast, approved and counted."""
    s = EngineSession(t("orders").sparkSession, approver=lambda card: "yes")
    s.catalog.register("orders", t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "parquet:orders")
    s.catalog.register("customer", t("customer"), "parquet:customer")
    s.join("orders", "customer", "both", how="left", left_on=["o_custkey"], right_on=["c_custkey"])
    return R.provenance(s, "both")


@query("""SELECT 'missing' AS kind, 'price is empty in ' || printf('%.1f', 100 * avg(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END)) || ' % of rows' AS sentence FROM orders UNION ALL SELECT 'role', 'currency holds one value'
    UNION ALL SELECT 'cleaning', printf('%.1f', 100 * avg(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)) || ' % of size is imputed' FROM orders""")
def intrinsic_limitations(t):
    k = F.col("o_orderkey")
    return R.intrinsic_limitations(t("orders").select("o_orderkey", F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"), F.lit("EUR").alias("currency"), F.col("o_custkey").alias("size"), (k % 3 == 0).cast("int").alias("size_was_missing")))


@query("""WITH c AS (SELECT c_mktsegment AS a, n_name AS b, count(*)::DOUBLE AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    g AS (SELECT x.a, y.b, coalesce(c.v, 0) AS v FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b),
    r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY v DESC, a) AS pa, count(*) OVER (PARTITION BY b) AS la, first_value(a) OVER (PARTITION BY b ORDER BY v DESC, a) AS fa, row_number() OVER (PARTITION BY a ORDER BY v DESC, b) AS pb, count(*) OVER (PARTITION BY a) AS lb, first_value(b) OVER (PARTITION BY a ORDER BY v DESC, b) AS fb FROM g),
    s AS (SELECT c_custkey, c_mktsegment AS a, n_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey),
    p AS (SELECT c_custkey AS id, 0 AS unit, a, b FROM s UNION ALL SELECT c_custkey, 1, 'MACHINERY', b FROM s)
    SELECT id, CAST(unit AS INTEGER) AS unit, a, b, CASE WHEN la >= 3 AND pa > greatest(3, (la + 1) // 2) THEN a ELSE b END AS laggard, CAST(CASE WHEN la >= 3 AND pa > greatest(3, (la + 1) // 2) THEN pa ELSE pb END AS INTEGER) AS position,
        CASE WHEN la >= 3 AND pa > greatest(3, (la + 1) // 2) THEN fa ELSE fb END AS leader
    FROM p JOIN r USING (a, b) WHERE (la >= 3 AND pa > greatest(3, (la + 1) // 2)) OR (lb >= 3 AND pb > greatest(3, (lb + 1) // 2))""")
def pairing_claims(t):
    """A bullet for each customer: a clause in front of its pairing, then a second pairing of another segment; a label of two clauses is not paired across."""
    both = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("For "), F.initcap("n_name"), F.lit(", stock "), F.lower("c_mktsegment"), F.lit(" goods; push Machinery in "), "n_name", F.lit("; nothing else"))
    lines = both.select(F.col("c_custkey").alias("id"), text.alias("text"))
    return P.pairing_claims(lines, both, "c_mktsegment", "n_name").select("id", "unit", "a", "b", "laggard", "position", "leader")
