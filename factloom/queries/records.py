"""Journals, fine-tuning rows, indexes and checked arithmetic."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import journal as N
from ..operators import records as R
from ..sources.store import DocumentStore
from . import query


def nodes(t):
    """A node per event: users are runs, each event's parent is the one before."""
    e = t("events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select("user_id", F.col("event_id").alias("id"), before.alias("parent_id"), F.col("value").alias("metric"), (F.col("event_type") == "error").alias("is_buggy"), (F.col("user_id") % 2 == 0).alias("lower_is_better"))


@query("""WITH g AS (SELECT user_id, event_id AS id, value, CASE WHEN user_id % 2 = 0 THEN value ELSE -value END AS k FROM events WHERE event_type <> 'error')
    SELECT user_id, id, value AS metric, CAST(row_number() OVER (PARTITION BY user_id ORDER BY k, id) AS INTEGER) AS place FROM g QUALIFY place <= 3""")
def journal_best(t):
    return R.best_nodes(nodes(t), "user_id", 3).select("user_id", "id", "metric", "place")


@query("SELECT user_id, event_id AS id FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM events) WHERE event_type = 'error' AND event_id = last")
def journal_buggy_leaves(t):
    return R.buggy_leaves(nodes(t)).select("user_id", "id")


@query("""WITH i AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events)
    SELECT user_id, event_id, CAST(CASE WHEN event_type = 'click' THEN sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) ELSE 0 END AS BIGINT) AS run FROM i""")
def error_runs(t):
    return R.run_lengths(t("events"), ["user_id"], "event_id", F.col("event_type") == "click").select("user_id", "event_id", "run")


@query("""WITH RECURSIVE n AS (SELECT user_id, event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent_id, event_type IN ('click', 'view') AS debug FROM events),
    m AS MATERIALIZED (SELECT *, sum(CASE WHEN debug AND parent_id IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY id) AS island FROM n)
    SELECT user_id, id, CAST(sum(CASE WHEN debug AND parent_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY id) AS BIGINT) AS depth FROM m""")
def debug_depth(t):
    """Each event's parent is the one before, so SQL can count by islands; the operator walks the parents."""
    n = nodes(t).join(t("events").select(F.col("event_id").alias("id"), F.when(F.col("event_type").isin("click", "view"), "debug").otherwise("draft").alias("stage")), "id")
    return R.debug_depth(n, "user_id").select("user_id", "id", "depth")


@query("""WITH p AS (SELECT conv_id, turn, text AS prompt, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS completion, role FROM conversations), k AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS n, count(*) OVER () AS total FROM p WHERE role = 'user' AND trim(coalesce(prompt, '')) <> '' AND trim(coalesce(completion, '')) <> '')
    SELECT conv_id, turn, CASE WHEN total >= 10 AND n <= greatest(1, floor(total * 0.1)) THEN 'validation' ELSE 'train' END AS part FROM k""")
def finetune_split(t):
    c = t("conversations").withColumn("completion", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'user'")
    return R.finetune_rows(c, "text", "completion", ["conv_id", "turn"]).select("conv_id", "turn", "part")


@query("SELECT l_orderkey, l_linenumber, l_orderkey % 2 = 0 AS holds FROM lineitem")
def arithmetic_check(t):
    expression = F.concat(F.col("l_quantity").cast("string"), F.lit(" * ("), F.col("l_partkey").cast("string"), F.lit(" + 1)"))
    claim = F.col("l_quantity") * (F.col("l_partkey") + 1) * F.when(F.col("l_orderkey") % 2 == 0, 1.0).otherwise(1.5)
    return R.check_arithmetic(t("lineitem").select("l_orderkey", "l_linenumber", expression.alias("e"), claim.alias("c")), "e", "c").select("l_orderkey", "l_linenumber", "holds")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'verified' ELSE '' END AS status,
    CASE WHEN o_orderkey % 4 = 1 THEN [o_orderkey || ' + 1 = ' || (o_orderkey * 2 + 5)] ELSE [] END AS wrong FROM orders""")
def computation_check(t):
    """Compound claims of every order: right ones with thousands commas, a wrong one beside a right one, a ratio in per cent, and nothing to check."""
    k, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    right = F.concat(F.lit("total = 2; "), key, F.lit(" * 1,000 = "), F.format_number(F.col("o_orderkey") * 1000, 0), F.lit("; 7 - 2 = 5 (about)"))
    wrong = F.concat(key, F.lit(" + 1 = "), (F.col("o_orderkey") * 2 + 5).cast("string"), F.lit("; 1 + 1 = 2"))
    text = F.when(k == 0, right).when(k == 1, wrong).when(k == 2, F.lit("(5 - 4) / 4 = 0.25 = 25%; 1 / 4 * 100 = 25.0 %")).otherwise(F.lit("it rose; x = y; 5 = "))
    return R.check_computations(t("orders").select("o_orderkey", text.alias("s")), "o_orderkey", "s")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS version FROM documents")
def index_upsert(t):
    d = t("documents")
    old, new = d.select("doc_id", F.lit("old").alias("version")), d.filter("doc_id % 5 = 0").select("doc_id", F.lit("new").alias("version"))
    return R.upsert(old, new, "doc_id")


@query(r"""WITH f AS (SELECT DISTINCT 'page' || page_id || '.html' AS name, html AS content FROM pages UNION SELECT DISTINCT source || doc_id || '.txt', text FROM documents WHERE text IS NOT NULL)
    SELECT name, left(sha256(content), 12) AS digest, CAST(len(string_split_regex(content, '\r?\n')) AS BIGINT) AS n_lines, CAST(CASE WHEN name LIKE 'page%.html' THEN 1 ELSE 2 END AS INTEGER) AS round FROM f""")
def document_store(t):
    """Pages are ingested first, then pages and documents together, of which only the documents are parsed, then all once more."""
    spark = t("pages").sparkSession
    pages = t("pages").select(F.concat(F.lit("page"), "page_id", F.lit(".html")).alias("name"), F.col("html").alias("content"))
    both = pages.union(t("documents").filter("text IS NOT NULL").select(F.concat("source", "doc_id", F.lit(".txt")), "text"))
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    store = DocumentStore(spark, f"{base}/store-{uuid.uuid4().hex}")
    for files in (pages, both, both):
        store.ingest(files)
    runs = store.documents().groupBy("run").agg(F.min("at").alias("at")).withColumn("round", F.row_number().over(Window.orderBy("at")))  # a row per ingest
    kept = store.documents().join(F.broadcast(runs.drop("at")), "run").select("doc_id", "name", F.left("sha256", F.lit(12)).alias("digest"), "round")
    return kept.join(store.lines().groupBy("doc_id").agg(F.count("*").alias("n_lines")), "doc_id").select("name", "digest", "n_lines", "round")


@query("""WITH n AS (SELECT user_id, event_id, event_type, value, event_type = 'error' AS bad, user_id % 2 = 0 AS lower FROM events),
    p AS (SELECT *, CASE WHEN bad THEN 1 WHEN value IS NOT NULL THEN 0 END AS part FROM n), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY event_id DESC) AS back, count(*) FILTER (part = 0) OVER (PARTITION BY user_id) AS good FROM p WHERE part IS NOT NULL),
    k AS (SELECT * FROM b WHERE back <= CASE part WHEN 0 THEN 12 ELSE greatest(2, 12 - least(12, good)) END)
    SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY part, back DESC) AS INTEGER) AS place, 'attempt ' || event_id || ' [' || event_type || ']' || CASE part WHEN 0 THEN CASE WHEN lower THEN ' (lower better)' ELSE '' END || ': plan ' || event_id ELSE ' FAILED: out ' || event_id END AS line FROM k""")
def journal_summary(t):
    """The last attempts of each user's run; the metric's digits are left to the test."""
    e = t("events").select("user_id", F.col("event_id").alias("id"), F.col("event_id").alias("step"), F.col("event_type").alias("stage"), F.col("value").alias("metric"), (F.col("event_type") == "error").alias("is_buggy"), (F.col("user_id") % 2 == 0).alias("lower_is_better"))
    e = e.withColumns({"plan": F.concat(F.lit("plan "), "id"), "analysis": F.lit(""), "term_out": F.concat(F.lit("out "), "id")})
    return N.journal_summary(e, "user_id").withColumn("line", F.regexp_replace("line", r" metric=[-0-9.Ee]+", ""))


@query("""WITH e AS (SELECT user_id AS session, event_id AS x, CASE WHEN event_type = 'error' THEN 'correction' WHEN event_type = 'purchase' THEN 'end' WHEN event_type = 'view' THEN 'task' ELSE 'call' END AS kind, event_type || ' ' || event_id || ' and what it was about at that time' AS text FROM events)
    SELECT session, min(x) AS began, max(x) FILTER (kind = 'end') - min(x) AS duration, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'correction') AS corrections, arg_max(text, x) FILTER (kind = 'end') AS outcome,
        left(coalesce(arg_min(text, x) FILTER (kind = 'task'), ''), 36) AS task FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def list_sessions(t):
    e = t("events").withColumn("text", F.concat("event_type", F.lit(" "), "event_id", F.lit(" and what it was about at that time")))
    kind = F.when(F.col("event_type") == "error", "correction").when(F.col("event_type") == "purchase", "end").when(F.col("event_type") == "view", "task").otherwise("call")
    return N.list_sessions(e, "user_id", "event_id", kind, F.col("text"))


@query(r"""SELECT CAST(conv_id + 1000 AS VARCHAR) AS session, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place, '[' || role || '] ' || left(trim(regexp_replace(text, '\s+', ' ', 'g')), 300) AS line FROM conversations WHERE CAST(conv_id + 1000 AS VARCHAR) LIKE '1001%'""")
def recall_session(t):
    c = t("conversations").withColumn("session", (F.col("conv_id") + 1000).cast("string"))
    return N.recall_session(c, "session", "turn", "role", "text", "1001")

