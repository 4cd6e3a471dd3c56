"""Outlines: sections with parents and paths, blocks, fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import outline as O
from . import query


def heading_lines(t):
    """All lines of all documents: ten to a page; every seventh line that is short and no list item is set larger, in one of three sizes, by its number."""
    d = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    size = F.when(F.col("pos") % 7 == 3, F.element_at(F.array(F.lit(20.0), F.lit(16.0), F.lit(14.0)), (F.col("pos") * 5 % 11 % 3 + 1).cast("int"))).otherwise(10.0)
    # A long last line keeps the body's size that of most characters.
    tail = t("documents").select("doc_id", F.lit(100_000).alias("pos"), F.repeat(F.lit("body "), F.length(F.coalesce("text", F.lit(""))) + 1).alias("text"), F.lit(10.0).alias("size"))
    rows = d.select("doc_id", "pos", "text", size.alias("size")).union(tail)
    return rows.select("doc_id", (F.floor(F.col("pos") / 10) + 1).cast("int").alias("page"), (F.col("pos") % 10).cast("int").alias("line"), "text", "size", F.lit(False).alias("bold"), (F.col("pos") % 10 * 12.0).alias("top"), F.lit(10.0).alias("height"))


MARK = r"^\s*(?:\(cid:\d+\)|[•·◦▪‣∙*\-–—]|\(?\d{1,2}[.)]|\(?[a-zA-Z][.)])\s*"
LINES = f"""l AS MATERIALIZED (SELECT doc_id, CAST(pos AS BIGINT) AS pos, x AS text, CASE WHEN pos % 7 = 3 AND length(x) <= 90 AND NOT regexp_matches(x, '{MARK}') THEN list_extract([20, 16, 14], CAST(pos * 5 % 11 % 3 + 1 AS INTEGER)) END AS size
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
    h AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l WHERE size IS NOT NULL),
    v AS MATERIALIZED (SELECT h.*, n.level FROM h JOIN (SELECT doc_id, size, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS INTEGER) AS level FROM (SELECT DISTINCT doc_id, size FROM h)) n USING (doc_id, size))"""


@query(f"""WITH RECURSIVE {LINES},
    p AS MATERIALIZED (SELECT v.doc_id, v.section, v.pos, v.text, v.level, (SELECT max(e.section) FROM v e WHERE e.doc_id = v.doc_id AND e.section < v.section AND e.level < v.level) AS parent FROM v),
    w(doc_id, section, path) AS (SELECT doc_id, section, [text] FROM p WHERE parent IS NULL UNION ALL SELECT p.doc_id, p.section, list_append(w.path, p.text) FROM p JOIN w ON w.doc_id = p.doc_id AND w.section = p.parent)
    SELECT doc_id, section, CAST(pos // 10 + 1 AS INTEGER) AS page, text AS heading, level, parent, path FROM p JOIN w USING (doc_id, section)
    UNION ALL SELECT doc_id, 0, CASE WHEN text LIKE '%' AND (SELECT min(l.pos) FROM l WHERE l.doc_id = d.doc_id) IS NULL THEN 10001 ELSE 1 END, NULL, 0, NULL, [] FROM documents d
    WHERE NOT coalesce((SELECT bool_or(size IS NOT NULL) FROM l WHERE l.doc_id = d.doc_id AND pos = 0), false)""")
def document_tree(t):
    return O.document_tree(heading_lines(t))


def block_lines(t):
    """A page for each conversation, its turns by turns a field, an item of a list, and text that ends in a broken word, apart from the line before at every sixth."""
    text = F.regexp_replace(F.substring("text", 1, 40), r"[^a-z ]", "")
    k = F.col("turn") % 5
    said = F.when(k == 0, F.concat(F.lit("Turn: t"), F.col("turn").cast("string"), F.lit(" | Signed | : "), "role")).when(k == 1, F.concat(F.lit("• item "), "role")).otherwise(F.concat(F.lit("Zz "), text, F.lit(" brok-")))
    top = F.col("turn") * 12.0 + F.floor(F.col("turn") / 6) * 30.0
    return t("conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), F.col("turn").alias("line"), said.alias("text"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"), top.alias("top"), F.lit(10.0).alias("height"))


@query(r"""WITH l AS (SELECT conv_id AS doc_id, turn, turn % 5 AS k, CASE turn % 5 WHEN 0 THEN 'key_values' WHEN 1 THEN 'list' ELSE 'paragraph' END AS kind, role, 'Zz ' || regexp_replace(substr(text, 1, 40), '[^a-z ]', '', 'g') || ' brok' AS body, turn * 12 + turn // 6 * 30 AS top FROM conversations),
    g AS (SELECT *, CASE WHEN kind = lag(kind) OVER w AND NOT (kind = 'paragraph' AND top - lag(top) OVER w > 17.5) THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY turn)),
    b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY turn) AS INTEGER) AS block FROM g)
    SELECT doc_id, block, any_value(kind) AS type, CASE WHEN any_value(kind) = 'paragraph' THEN string_agg(body, '' ORDER BY turn) || '-' END AS text,
        CASE WHEN any_value(kind) = 'list' THEN string_agg('item ' || role, '|' ORDER BY turn) END AS items, CASE WHEN any_value(kind) = 'list' THEN false END AS ordered,
        CASE WHEN any_value(kind) = 'key_values' THEN 'Turn=t' || min(turn) || '|Signed=' || arg_min(role, turn) END AS fields FROM b GROUP BY 1, 2""")
def line_blocks(t):
    pair = lambda p: F.concat(p["key"], F.lit("="), p["value"])
    made = O.line_blocks(block_lines(t))
    return made.select("doc_id", "block", "type", "text", F.array_join("items", "|").alias("items"), "ordered", F.array_join(F.transform("fields", pair), "|").alias("fields"))


@query("""SELECT o_orderkey AS doc_id, unnest(['Status', 'Order Date', 'Priority']) AS key, unnest([o_orderstatus, strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority]) AS value FROM orders""")
def document_fields(t):
    """Fields of a label-value line and of a sentence in prose, said again later with another value; clauses with a colon are none."""
    o = t("orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    said = F.array(
        F.concat(F.lit("Status | : "), "o_orderstatus", F.lit(" | तिथि / Order Date: "), "d", F.lit(" | Who: none")), F.lit("There was one conclusion: the order should go on"),
        F.concat(F.lit("It came late. Priority: "), "o_orderpriority", F.lit("; Status: later.")), F.lit("12: 30"), F.lit("Note: It was. But not so."),
    )
    lines = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(said).alias("line", "text"))
    lines = lines.select("*", F.lit(10.0).alias("size"), F.lit(False).alias("bold"), (F.col("line") * 12.0).alias("top"), F.lit(10.0).alias("height"))
    return O.document_fields(O.line_blocks(lines))


@query(f"""WITH {LINES} SELECT d.doc_id, (SELECT arg_min(l.text, (-coalesce(l.size, CASE WHEN pos % 7 = 3 THEN list_extract([20, 16, 14], CAST(pos * 5 % 11 % 3 + 1 AS INTEGER)) ELSE 10 END), l.pos)) FROM l WHERE l.doc_id = d.doc_id AND l.pos < 10) AS title FROM documents d WHERE text IS NOT NULL""")
def document_titles(t):
    return O.document_title(heading_lines(t))
