"""Grids of tables: from rulings, cleaned, split, mended and merged."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grids as G
from . import query

# Every order is a page with one table, a row for each of its lines (one of each number), under a header.
ONCE = "SELECT l_orderkey, l_linenumber, any_value(l_partkey) AS l_partkey, any_value(l_linestatus) AS l_linestatus FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2"


#: Order lines in a part: what is laid out from them is grouped and sorted in one task, however many there are.
PART_LINES = 300_000


def order_lines(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    parts = max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // PART_LINES))  # counted from the files' footers
    lines = lines.repartition(parts, "l_orderkey")  # dealt by order once, while rows are narrow, for all that follows
    li = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_linestatus").alias("l_linestatus"))
    return li.withColumn("nth", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))


def ruled_page(t):
    """rects and words. Cells have an inner and an outer frame, padding strips lie between, a column and a row hold no word, second lines
    of wrapped cells are rows of their own inside the first's band, and a callout of one cell stands below."""
    row = lambda nth, a, b, c: F.struct(nth.alias("nth"), a.alias("a"), b.alias("b"), c.alias("c"))
    line = row(F.col("nth"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linestatus"))
    both = F.when(F.col("nth") == 1, F.array(row(F.lit(0), F.lit("no"), F.lit("key"), F.lit("status")), line)).otherwise(F.array(line))  # the header is over the first line
    rows = order_lines(t).select(F.col("l_orderkey").alias("doc_id"), F.explode_outer(both).alias("r")).select("doc_id", "r.*").withColumn("y", F.col("nth") * 30.0 + 50)
    at_top = lambda made, more: F.when(F.col("nth") == 0, F.concat(F.array(*made), F.array(more))).otherwise(F.array(*made))
    word = lambda k, text, left, top: F.struct(k.alias("word_idx"), text.alias("text"), F.lit(left).alias("left"), top.alias("top"))
    own = lambda k, text, left, down=0.0: word(F.col("nth") * 10 + k, text, left, F.col("y") + 4 + down)
    said = at_top([own(0, F.col("a"), 12.0), own(1, F.lit("part"), 72.0), own(2, F.col("b"), 72.0, 13.0), own(3, F.col("c"), 175.0)], word(F.lit(-1), F.lit("note"), 12.0, F.lit(22.0)))
    words = rows.select("doc_id", F.explode_outer(said).alias("w")).select("doc_id", F.lit(1).alias("page"), "w.*", F.lit(20.0).alias("width"), F.lit(8.0).alias("height"))
    rect = lambda r, x0, y0, x1, y1, table=0: F.struct(F.lit(table).alias("table_id"), r.alias("row"), F.lit(x0).alias("x0"), y0.alias("y0"), F.lit(x1).alias("x1"), y1.alias("y1"))
    cell = lambda r, x0, y0, x1, y1: rect(F.col("nth") * 3 + r, x0, F.col("y") + y0, x1, F.col("y") + y1)
    columns = [(10.0, 60.0), (70.0, 160.0), (170.0, 260.0), (270.0, 300.0)]  # nothing is written in the last
    made = [cell(0, x0, 0.0, x1, 28.0) for x0, x1 in columns] + [cell(0, 68.04, 0.0, 162.0, 28.0), cell(0, 62.0, 0.0, 68.0, 28.0), cell(1, 70.0, 14.0, 160.0, 28.0)]
    rects = rows.select("doc_id", F.explode_outer(at_top(made, rect(F.lit(0), 10.0, F.lit(20.0), 260.0, F.lit(30.0), 1))).alias("r")).select("doc_id", F.lit(1).alias("page"), "r.*")
    return rects, words


RULED = f"""WITH l AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS nth, CAST(l_linenumber AS VARCHAR) AS a, 'part ' || l_partkey AS b, l_linestatus AS c FROM ({ONCE})),
    g AS (SELECT * FROM l UNION ALL SELECT DISTINCT doc_id, 0, 'no', 'part key', 'status' FROM l)
    SELECT doc_id, nth AS row, CAST(0 AS INTEGER) AS col, 'no' AS "column", a AS text, 12.0::DOUBLE AS x0, (nth * 30 + 54)::DOUBLE AS y0, 32.0::DOUBLE AS x1, (nth * 30 + 62)::DOUBLE AS y1 FROM g
    UNION ALL SELECT doc_id, nth, 1, 'part key', b, 72, nth * 30 + 54, 92, nth * 30 + 75 FROM g UNION ALL SELECT doc_id, nth, 2, 'status', c, 175, nth * 30 + 54, 195, nth * 30 + 62 FROM g"""


@query(RULED)
def ruled_tables(t):
    return G.ruled_tables(*ruled_page(t)).select("doc_id", "row", "col", "column", "text", "x0", "y0", "x1", "y1")


def ragged(t):
    """Grids of orders with a margin column that is always empty, blank rows, and white space of all kinds."""
    li = order_lines(t)
    cell = lambda row, k, c: F.struct(row.alias("row"), F.lit(k).alias("col"), c.alias("text"))
    own, after = F.col("nth") * 2, F.col("nth") * 2 + 1
    said = [cell(own, 0, F.lit(" ")), cell(own, 1, F.concat(F.lit(" no\n"), "l_linenumber")), cell(own, 3, F.when(F.col("l_linestatus") == "F", F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("l_partkey"), F.lit("  x"))))]
    blank = [cell(after, 0, F.lit("")), cell(after, 1, F.lit(None).cast("string")), cell(after, 3, F.lit("\t"))]
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_id"), F.explode(F.array(*said, *blank)).alias("c")).select("doc_id", "page", "table_id", "c.*")


@query(f"""WITH l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS row, bool_or(l_linestatus <> 'F') OVER (PARTITION BY l_orderkey) AS two FROM ({ONCE}))
    SELECT l_orderkey AS doc_id, row, CAST(0 AS INTEGER) AS col, 'no ' || l_linenumber AS text FROM l UNION ALL SELECT l_orderkey, row, 1, CASE WHEN l_linestatus = 'F' THEN '' ELSE l_partkey || ' x' END FROM l WHERE two""")
def normalise_grids(t):
    return G.normalise_grid(ragged(t)).select("doc_id", "row", "col", "text")


def fused_page(t):
    """Index and status run together. Even orders have them so in every row, odd ones only in rows of status F."""
    li = order_lines(t)
    odd = F.col("l_orderkey") % 2 == 1
    first = F.when(odd & (F.col("l_linestatus") != "F"), F.col("l_partkey").cast("string")).otherwise(F.concat(F.col("l_partkey").cast("string"), "l_linestatus"))
    cell = lambda row, k, c: F.struct(row.alias("row"), F.lit(k).alias("col"), c.alias("text"))
    body = F.array(cell(F.col("nth"), 0, first), cell(F.col("nth"), 1, F.lit("ok")))
    head = F.array(cell(F.lit(0), 0, F.lit("key status")), cell(F.lit(0), 1, F.lit("state")))  # over the first line
    made = li.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.when(F.col("nth") == 1, F.concat(head, body)).otherwise(body)).alias("c"))
    return made.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("table_id"), "c.*")


@query(f"""WITH l AS (SELECT l_orderkey AS doc_id, l_orderkey % 2 = 1 AND l_linestatus <> 'F' AS plain FROM ({ONCE})),
    n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (plain) AS plain FROM l GROUP BY 1)
    SELECT doc_id, n - plain AS n_fused, n - plain > 0 AND NOT (n >= 3 AND plain > 0 AND n - plain < 0.9 * n) AS split,
        CAST(CASE WHEN n - plain > 0 AND NOT (n >= 3 AND plain > 0 AND n - plain < 0.9 * n) THEN 3 ELSE 2 END AS BIGINT) AS n_cols FROM n""")
def fused_cells(t):
    """How many cells have run together, and whether cutting them gives columns: refused where rows would shift against each other."""
    grid = fused_page(t)
    cut = G.split_fused(grid).groupBy("doc_id").agg(F.bool_and("split").alias("split"), F.count_distinct("col").alias("n_cols"))
    return G.fused_cells(grid).join(cut, "doc_id").select("doc_id", "n_fused", "split", "n_cols")


def cut_headers(t):
    """Headers of which a third are cut in the wrong places, a third have an index column without a name, and a third other words."""
    o = t("orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 3).alias("k"), "o_orderpriority")
    cells = F.when(F.col("k") == 0, F.array(F.lit("pri"), F.lit("ority da"), F.lit("te"))).when(F.col("k") == 1, F.array(F.lit("p"), F.lit("riority"), F.lit(" date"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    names = F.when(F.col("k") == 0, F.array(F.lit("prior"), F.lit("ity"), F.lit("date"))).otherwise(F.array(F.lit("priority"), F.lit("date")))
    grid = o.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("table_id"), F.lit(0).alias("row"), F.posexplode(cells).alias("col", "text"))
    body = o.select("doc_id", F.lit(1), F.lit(0), F.lit(1), F.posexplode(F.array(F.lit("1"), F.col("o_orderpriority"), F.lit("x"))))
    return grid.union(body), o.select("doc_id", F.lit(1).alias("page"), names.alias("names"))


@query("""WITH h AS (SELECT o_orderkey AS doc_id, o_orderpriority AS p, CASE o_orderkey % 3 WHEN 0 THEN ['prior', 'ity', 'date'] WHEN 1 THEN ['', 'priority', 'date'] ELSE ['a', 'b', 'c'] END AS h FROM orders)
    SELECT doc_id, CAST(0 AS INTEGER) AS row, h AS cells, doc_id % 3 < 2 AS repaired FROM h UNION ALL SELECT doc_id, 1, ['1', p, 'x'], false FROM h""")
def header_repair(t):
    mended = G.repair_headers(*cut_headers(t))
    flag = mended.groupBy("doc_id", "row").agg(F.bool_or("repaired").alias("repaired"))
    return G.row_arrays(mended, ["doc_id"]).join(flag, ["doc_id", "row"]).select("doc_id", "row", "cells", "repaired")


def paged_grids(t):
    """A document for each customer, a page for each order: pages of text grids with a header on the first, then, for finished orders, ruled ones with theirs."""
    o = t("orders").select(F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy((F.col("o_orderstatus") == "F").cast("int"), "o_orderkey")).alias("page"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    ruled = F.col("o_orderstatus") == "F"
    head = F.when(ruled, F.array(F.lit("key"), F.concat(F.lit("as of "), F.left("o_orderpriority", F.lit(1))))).otherwise(F.array(F.lit("key"), F.lit("status")))
    row = lambda n, cells: F.struct(F.lit(n).alias("row"), cells.alias("cells"))
    body = row(1, F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")))
    rows = F.when(ruled | (F.col("page") == 1), F.array(row(0, head), body)).otherwise(F.array(body))
    cells = o.select("doc_id", "page", F.lit(0).alias("table_id"), F.explode(rows).alias("r")).select("doc_id", "page", "table_id", "r.row", F.posexplode("r.cells").alias("col", "text"))
    return cells, o.select("doc_id", "page", F.lit(0).alias("table_id"), F.when(ruled, "ruled").otherwise("text").alias("strategy"))


@query("""WITH o AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderkey) AS INTEGER) AS page, o_orderkey, o_orderstatus, o_orderstatus = 'F' AS ruled, left(o_orderpriority, 1) AS p FROM orders),
    g AS (SELECT *, CASE WHEN NOT coalesce(ruled = lag(ruled) OVER w AND (NOT ruled OR p = lag(p) OVER w), false) THEN 1 ELSE 0 END AS fresh FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
    n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS part FROM g),
    r AS (SELECT doc_id, part, page, 0 AS k, ['key', CASE WHEN ruled THEN 'as of ' || p ELSE 'status' END] AS cells FROM n WHERE fresh = 1 AND (ruled OR page = 1) UNION ALL SELECT doc_id, part, page, 1, [CAST(o_orderkey AS VARCHAR), o_orderstatus] FROM n)
    SELECT doc_id, part, page, CAST(row_number() OVER (PARTITION BY doc_id, part ORDER BY page, k) - 1 AS INTEGER) AS row, cells FROM r""")
def merged_grids(t):
    return G.merge_grids(*paged_grids(t))
