"""The outline of documents: headings with levels, sections with parents, typed blocks, fields and titles.

Lines are ``lines(doc_id, page, line, text, size, bold, top, height)``, ordered by page and line. Work is dealt by page: running numbers are
counted within a page and carried over pages by their aggregates, so a document of any length is no task's alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pairs as P
from .documents import body_size

#: Size of a heading against the body, its longest text, the gap that ends a paragraph in heights of the line before.
HEADING_SIZE, HEADING_CHARS, PARAGRAPH_GAP = 1.12, 90, 1.75


def may_head(text: Column) -> Column:
    """Short, and no item of a list."""
    return (F.length(text) <= HEADING_CHARS) & ~text.rlike(P.LIST_MARK)


def heading_test(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """Large for the document's body, or bold without reading like a sentence or a field; short, and no item of a list."""
    fits = may_head(text)
    large = (body > 0) & (size >= HEADING_SIZE * body)
    return fits & (large | (F.coalesce(bold, F.lit(False)) & ~text.rlike(r"[.,;]$") & (F.size(P.pairs(text)) == 0)))


def carried(rows: DataFrame, count: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the running sum of ``count`` (0 or 1) over the lines of a document."""
    per_page = rows.groupBy("doc_id", "page").agg(F.sum(count).alias("_n"))
    before = per_page.withColumn("_before", F.sum("_n").over(Window.partitionBy("doc_id").orderBy("page")) - F.col("_n")).drop("_n")
    upto = Window.partitionBy("doc_id", "page").orderBy("line")
    return rows.join(before, ["doc_id", "page"]).withColumn(out, F.col("_before") + F.sum(count).over(upto)).drop("_before")


def outlined_lines(lines: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """``lines`` with ``heading`` and ``section``: the number of headings so far, 0 for what comes before the first. The body's size is that of ``whole``, else of ``lines``."""
    rows = lines.join(body_size(lines if whole is None else whole), "doc_id", "left")
    rows = rows.withColumn("heading", F.coalesce(heading_test(F.col("text"), F.col("size"), F.col("bold"), F.coalesce("body", F.lit(0.0))), F.lit(False))).drop("body")
    return carried(rows.withColumn("_h", F.col("heading").cast("long")), "_h", "section").drop("_h")


def document_tree(lines: DataFrame) -> DataFrame:
    """doc_id, section, page, heading, level, parent, path: a row for each section.

    Level 1 is the largest size among a document's headings. A section's parent is the nearest earlier one of a lower level (null if there is none); ``path``
    has the headings from the outermost to its own. Lines before the first heading are section 0, of level 0 and without a heading; it is nobody's parent.
    """
    # Only lines that may be headings carry their text (and no more than 90 characters); of the others the place is enough.
    slim = lines.select("doc_id", "page", "line", F.when(may_head(F.col("text")), F.col("text")).alias("text"), "size", "bold")
    rows = outlined_lines(slim, lines)
    heads = rows.filter("heading").select("doc_id", "page", "section", F.col("text").alias("heading"), F.coalesce("size", F.lit(0.0)).alias("size"))
    sizes = heads.select("doc_id", "size").distinct().withColumn("level", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))))
    heads = heads.join(sizes, ["doc_id", "size"]).drop("size")
    # Within a page by its headings so far; before the page by the last section of each lower level, carried over the pages that have one.
    mine = F.collect_list(F.struct("section", "level")).over(Window.partitionBy("doc_id", "page").orderBy("section").rowsBetween(Window.unboundedPreceding, -1))
    here = F.array_max(F.transform(F.filter(mine, lambda x: x["level"] < F.col("level")), lambda x: x["section"]))
    heads = heads.withColumn("_here", here)
    last = heads.groupBy("doc_id", "page", F.col("level").alias("_low")).agg(F.max("section").alias("_last"))
    levels = sizes.select("doc_id", "level")
    lower = last.join(levels, "doc_id").filter("_low < level").groupBy("doc_id", "level", "page").agg(F.max("_last").alias("_last"))
    wanted = heads.select("doc_id", "level", "page").distinct().join(lower, ["doc_id", "level", "page"], "full")
    before = Window.partitionBy("doc_id", "level").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.join(wanted.withColumn("_before", F.max("_last").over(before)).drop("_last"), ["doc_id", "level", "page"])
    heads = heads.withColumn("parent", F.coalesce("_here", "_before")).select("doc_id", "section", "page", "heading", "level", "parent")
    # Paths by doubling: each round a section's path takes in that of the ancestor it ends at.
    deepest = heads.agg(F.max("level")).first()[0] or 1
    paths = heads.select("doc_id", "section", F.col("parent").alias("_up"), F.array("heading").alias("path"))
    for _ in range(math.ceil(math.log2(deepest)) if deepest > 1 else 0):
        above = paths.select("doc_id", F.col("section").alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_path"))
        paths = paths.join(above, ["doc_id", "_up"], "left").select("doc_id", "section", F.col("_next").alias("_up"), F.concat(F.coalesce("_path", F.array().cast("array<string>")), "path").alias("path"))
    front = rows.filter("section = 0").groupBy("doc_id").agg(F.min("page").alias("page"))
    none = F.lit(None)
    front = front.select("doc_id", F.lit(0).cast("long").alias("section"), "page", none.cast("string").alias("heading"), F.lit(0).alias("level"), none.cast("long").alias("parent"), F.array().cast("array<string>").alias("path"))
    return heads.join(paths.select("doc_id", "section", "path"), ["doc_id", "section"]).unionByName(front)


def document_title(lines: DataFrame) -> DataFrame:
    """doc_id, title: the first of the largest lines of page 1; null where no size is known."""
    first = lines.filter("page = 1").groupBy("doc_id").agg(F.max(F.struct("size", (-F.col("line")).alias("_l"), "text")).alias("m"))
    return first.select("doc_id", F.when(F.coalesce("m.size", F.lit(0.0)) > 0, F.col("m.text")).alias("title"))


def line_blocks(lines: DataFrame, outlined: bool = False) -> DataFrame:
    """doc_id, section, page, block (from 1 within the page), type, text, items, ordered, fields: paragraphs, lists and label-value blocks.

    Neighbouring lines of one kind are a block; another page or section ends it, and a paragraph also a gap of 1.75 heights of the line before. A
    paragraph's lines are joined, words broken by a hyphen whole again; items of a list lose their marks, empty ones go; of fields with one label
    the first stays. A block lies on one page, so it is made there.
    """
    rows = lines if outlined else outlined_lines(lines)
    body = rows.filter("NOT heading").withColumn("_pairs", P.pairs(F.col("text"))).withColumn("kind", P.line_kind(F.col("text"), F.col("_pairs")))
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    before = lambda c: F.lag(c).over(order)
    gap = (F.col("kind") == "paragraph") & (F.col("top") - before("top") > PARAGRAPH_GAP * before("height"))
    goes_on = (F.col("kind") == before("kind")) & (F.col("section") == before("section")) & ~F.coalesce(gap, F.lit(False))
    body = body.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("block", F.sum("_new").over(order).cast("int"))
    made = body.groupBy("doc_id", "section", "page", "block").agg(F.first("kind").alias("type"), F.array_sort(F.collect_list(F.struct("line", "text", "_pairs"))).alias("_l"))
    made = made.withColumn("_t", F.transform("_l", lambda x: x["text"]))
    items = F.filter(F.transform("_t", lambda x: F.trim(F.regexp_replace(x, P.LIST_MARK, ""))), lambda x: x != "")
    fields = P.first_of_each(F.flatten(F.transform("_l", lambda x: x["_pairs"])))
    kind = F.col("type")
    return made.select(
        "doc_id", "section", "page", "block", "type", F.when(kind == "paragraph", P.unwrapped(F.col("_t"))).alias("text"), F.when(kind == "list", items).alias("items"),
        F.when(kind == "list", F.ltrim(F.col("_t")[0]).rlike(P.ORDERED)).alias("ordered"), F.when(kind == "key_values", fields).alias("fields"),
    )


def document_fields(blocks: DataFrame) -> DataFrame:
    """doc_id, key, value: every field of a document, of its label-value blocks and of sentences in paragraphs; the first of each key."""
    found = F.when(F.col("type") == "key_values", F.col("fields")).when(F.col("type") == "paragraph", P.pairs_in_prose(F.col("text")))
    # The outer form: for the plain one Spark puts a filter before it that reads every sentence again, twice.
    rows = blocks.select("doc_id", "page", "block", F.posexplode_outer(found).alias("pos", "f")).filter("f IS NOT NULL")
    first = rows.groupBy("doc_id", F.col("f.key").alias("key")).agg(F.min(F.struct("page", "block", "pos", "f.value"))["value"].alias("value"))
    return first
