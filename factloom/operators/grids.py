"""Grids of tables: built from rulings and words, cleaned, split where cells have run together, headers mended, pages merged.

A grid is ``cells(<key>, row, col, text)``, rows and columns from 0, row 0 the header. Keys name a grid, by default ``doc_id, page, table_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import once

#: Least width of a column; least columns and rows of a table; least share of body rows that a split column fills.
COLUMN_WIDTH, LEAST_COLUMNS, LEAST_ROWS, FILL = 8.0, 2, 2, 0.9
#: Fixed value: where a digit touches a letter, or a letter a digit.
FUSED = r"(?<=\d)(?=[A-Za-z])|(?<=[A-Za-z])(?=\d)"
KEY = ["doc_id", "page", "table_id"]


def least_ranges(ranges: DataFrame, key: list[str], lo: str = "x0", hi: str = "x1") -> DataFrame:
    """Distinct ranges of each key that hold no other. In order of falling start (then rising end) all ranges inside one come before it, so
    it holds another exactly when the least end before it is not beyond its own: one window, no pairs."""
    before = Window.partitionBy(*key).orderBy(F.desc(lo), F.asc(hi)).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(*key, lo, hi).distinct().withColumn("_least", F.min(hi).over(before)).filter(F.col("_least").isNull() | (F.col("_least") > F.col(hi))).drop("_least")


def kept_bands(ordered: Column) -> Column:
    """Of ranges (lo, up: the end, negative) in order, each that begins at or after the end of the last kept."""
    return F.aggregate(
        ordered, F.array().cast("array<struct<lo: double, up: double>>"),
        lambda got, x: F.when((F.size(got) == 0) | (x["lo"] >= -F.element_at(got, -1)["up"]), F.concat(got, F.array(x))).otherwise(got),
    )


def bands(ranges: DataFrame, key: list[str], lo: str = "y0", hi: str = "y1") -> DataFrame:
    """Ranges taken from the top, the tallest of those that begin together, each kept if it begins at or after the end of the last kept.

    The rows of one key (a table on a page) are folded in order.
    """
    ordered = F.array_sort(F.collect_set(F.struct(F.col(lo).alias("lo"), (-F.col(hi)).alias("up"))))
    kept = kept_bands(ordered)
    rows = ranges.withColumns({lo: F.col(lo).cast("double"), hi: F.col(hi).cast("double")}).groupBy(*key).agg(kept.alias("_kept"))
    return rows.select(*key, F.explode("_kept").alias("_b")).select(*key, F.col("_b.lo").alias(lo), (-F.col("_b.up")).alias(hi))


def ruled_tables(rects: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, page, table_id, row, col, column, text and box (x0, y0, x1, y1) of each cell of the tables that rulings enclose.

    ``rects(doc_id, page, table_id, row, x0, y0, x1, y1)`` are the cells that were detected, by row; ``words(doc_id, page, word_idx, text, left,
    top, width, height)`` what stands on the pages. Columns are the distinct ranges of cells wider than a border's padding, without those that hold
    another and those without words; rows the bands of detected rows without those that overlap an earlier one or hold no word. A word belongs
    to the columns that hold its centre and the rows that hold its top. With fewer than two columns or rows there is no table. ``column`` is the header's
    text when every cell of the first row has some, else col1, col2, ... Cells without words have their own rectangle as box.
    """
    near = lambda c: F.round(c, 1)
    page = ["doc_id", "page"]
    # Ranges of one table, in one row, meet the words of one page, in another; all that follows stays within the row of a table.
    # Rows of cells and distinct ranges across are plain aggregates: only these, far fewer than the cells, are gathered.
    across = ["tx0", "ty0", "tx1", "ty1"]
    band = F.struct(near(F.min("y0")).cast("double").alias("lo"), (-near(F.max("y1")).cast("double")).alias("up"))
    ranges = rects.groupBy(*KEY, "row").agg(F.min("x0").alias("tx0"), F.min("y0").alias("ty0"), F.max("x1").alias("tx1"), F.max("y1").alias("ty1"), band.alias("_tall"))
    wide = rects.filter(F.col("x1") - F.col("x0") > COLUMN_WIDTH).select(*KEY, F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1")).distinct()
    ranges = ranges.unionByName(wide.select(*KEY, F.struct((-near(F.col("x0"))).alias("lo"), near(F.col("x1")).alias("hi")).alias("_wide")), allowMissingColumns=True)
    box = ranges.groupBy(*KEY).agg(*[f(c).alias(c) for c, f in zip(across, (F.min, F.min, F.max, F.max), strict=True)], F.sort_array(F.collect_list("_wide")).alias("_wide"), F.sort_array(F.collect_set("_tall")).alias("_tall"))
    none = F.struct(F.lit(None).cast("double").alias("least"), F.array().cast("array<struct<x0: double, x1: double>>").alias("kept"))
    holds = lambda got, x: F.coalesce(got["least"] <= x["hi"], F.lit(False))  # noqa: E731  (in order of falling start: ``least_ranges`` says why)
    kept = lambda got, x: F.when(holds(got, x), got["kept"]).otherwise(F.concat(got["kept"], F.array(F.struct((-x["lo"]).alias("x0"), x["hi"].alias("x1")))))
    least = F.aggregate("_wide", none, lambda got, x: F.struct(F.least(got["least"], x["hi"]).alias("least"), kept(got, x).alias("kept")), lambda got: got["kept"])
    box = box.select(*KEY, *across, F.sort_array(least).alias("_columns"), F.transform(kept_bands(F.col("_tall")), lambda x: F.struct(x["lo"].alias("y0"), (-x["up"]).alias("y1"))).alias("_rows"))
    right = F.col("left") + F.col("width")
    said = F.struct("top", "left", "word_idx", "text", right.alias("right"), (F.col("top") + F.col("height")).alias("bottom"), ((F.col("left") + right) / 2).alias("centre"))
    w = words.groupBy(*page).agg(F.sort_array(F.collect_list(said)).alias("_words"))  # in the order in which they are read
    tables = box.hint("merge").join(w, page).withColumn("_words", F.filter("_words", lambda x: x["top"].between(F.col("ty0") - 1, F.col("ty1") + 1)))
    # A column or row is numbered among those that hold a word; a word outside of the columns still makes a row.
    in_column = lambda x, c: x["centre"].between(c["x0"] - 0.5, c["x1"] + 0.5)
    in_row = lambda x, r: x["top"].between(r["y0"] - 1, r["y1"] + 1)
    on_table = lambda x: x["centre"].between(F.col("tx0") - 0.5, F.col("tx1") + 0.5)
    of_row = lambda r: F.struct(r["y0"].alias("y0"), r["y1"].alias("y1"), F.filter("_words", lambda x: in_row(x, r)).alias("said"))
    has_word = lambda test: F.exists("_words", test)
    tables = tables.withColumns({"_columns": F.filter("_columns", lambda c: has_word(lambda x: in_column(x, c))), "_rows": F.filter("_rows", lambda r: has_word(lambda x: in_row(x, r) & on_table(x)))})
    tables = tables.withColumn("_rows", F.when((F.size("_columns") >= LEAST_COLUMNS) & (F.size("_rows") >= LEAST_ROWS), F.transform("_rows", of_row)))
    line = lambda found: F.array_join(found["text"], " ")
    head = F.transform("_columns", lambda c: line(F.filter(F.get("_rows", 0)["said"], lambda x: in_column(x, c))))
    tables = tables.withColumn("_head", head).withColumn("_head", F.when(F.forall("_head", lambda h: F.length(F.trim(h)) > 0), F.col("_head")))
    # A filter of tables, and the one that Spark puts before an explode that is no outer one, would go below all this and make it again for itself.
    lines = tables.select(*KEY, "_columns", "_head", F.posexplode_outer("_rows").alias("row", "_r")).filter("row IS NOT NULL")
    held = lines.select(*KEY, "row", "_head", "_r.y0", "_r.y1", F.posexplode_outer(F.transform("_columns", lambda c: F.struct(c["x0"].alias("x0"), c["x1"].alias("x1"), F.filter("_r.said", lambda x: in_column(x, c)).alias("w")))).alias("col", "_c"))
    column = F.coalesce(F.get("_head", F.col("col")), F.concat(F.lit("col"), F.col("col") + 1))
    edge = lambda found, own: F.round(F.coalesce(found, F.col(own)), 2)
    return held.select(*KEY, "row", "col", column.alias("column"), line(F.col("_c.w")).alias("text"), edge(F.array_min("_c.w.left"), "_c.x0").alias("x0"), edge(F.array_min("_c.w.top"), "y0").alias("y0"), edge(F.array_max("_c.w.right"), "_c.x1").alias("x1"), edge(F.array_max("_c.w.bottom"), "y1").alias("y1"))


def normalise_grid(cells: DataFrame, key: list[str] = KEY) -> DataFrame:
    """White space of cells reduced, rows and columns that are empty throughout dropped, the others numbered anew, missing cells filled in blank."""
    clean = cells.select(*key, "row", "col", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")).alias("text")).filter("text <> ''")
    # Rows are gathered once; the columns of a grid are those of all its rows, most of which have the same: no join, and grids stay where they are.
    rows = clean.dropna(subset=[*key, "row", "col"]).groupBy(*key, "row").agg(F.collect_list(F.struct("col", "text")).alias("_said"))
    grid = Window.partitionBy(*key)
    cols = F.collect_set(F.array_sort(F.array_distinct(F.transform("_said", lambda x: x["col"])))).over(grid)
    rows = rows.withColumns({"_cols": cols, "_row": F.row_number().over(grid.orderBy("row")) - 1}).withColumn("_cols", F.array_sort(F.array_distinct(F.flatten("_cols"))))
    here = lambda c: F.transform(F.filter("_said", lambda x: x["col"] == c), lambda x: x["text"])
    blank = lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))
    full = rows.select(*key, F.col("_row").alias("row"), F.posexplode(F.transform("_cols", lambda c: once(here(c), blank))).alias("col", "_texts"))
    return full.select(*key, "row", "col", F.explode("_texts").alias("text"))


def row_arrays(cells: DataFrame, key: list[str]) -> DataFrame:
    """key, row and ``cells``: the row's texts in order."""
    return cells.groupBy(*key, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("cells"))


def _cells(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.select(*key, "row", F.posexplode("cells").alias("col", "text"))


def fused_cells(cells: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Per grid: how many cells hold two values without a separator."""
    return cells.groupBy(*key).agg(F.count_if(F.col("text").rlike(FUSED)).alias("n_fused"))


def split_fused(cells: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Cells cut where a digit touches a letter, rows padded to the widest; with ``split``: whether the grid was cut.

    A grid stays as it was when the cut would shift rows against each other: some column is then filled, but in under nine tenths of the
    rows below the first that say anything. Fewer than three such rows prove nothing.
    """
    cut = lambda c: F.when((c == "") | c.isNull(), F.array(c)).otherwise(F.split(c, FUSED))
    made = row_arrays(cells.dropna(subset=key), key).withColumn("_p", F.transform("cells", cut)).withColumn("parts", F.flatten("_p"))
    grid = Window.partitionBy(*key)
    said = (F.col("row") > 0) & F.exists("parts", lambda c: F.coalesce(c != "", F.lit(False)))
    made = made.withColumns({"_width": F.max(F.size("parts")).over(grid), "_any": F.bool_or(F.exists("_p", lambda p: F.size(p) > 1)).over(grid), "_n": F.count_if(said).over(grid)})
    # A row's parts, padded, beside its cells, of which there are no more: which of the two it is that comes out is known when its grid's columns are.
    padded = F.concat("parts", F.array_repeat(F.lit(""), F.col("_width") - F.size("parts")))
    both = F.transform(padded, lambda c, i: F.struct(c.alias("part"), F.get(F.col("cells"), i).alias("cell"), (i < F.size("cells")).alias("own")))
    made = made.select(*key, "row", "_any", "_n", F.posexplode(both).alias("col", "_x"))
    filled = F.count_if((F.col("row") > 0) & (F.col("_x.part") != "")).over(Window.partitionBy(*key, "col"))
    made = made.withColumn("_torn", (F.col("_n") >= 3) & (filled > 0) & (filled < FILL * F.col("_n"))).withColumn("split", F.col("_any") & ~F.bool_or("_torn").over(grid))
    return made.filter(F.col("split") | F.col("_x.own")).select(*key, "row", "split", "col", F.when(F.col("split"), F.col("_x.part")).otherwise(F.col("_x.cell")).alias("text"))


def repair_headers(cells: DataFrame, first_lines: DataFrame, key: list[str] = KEY) -> DataFrame:
    """A header row that was cut in the wrong places becomes the words of its page's first line; with ``repaired``.

    ``first_lines(doc_id, page, names)``: those words in order. Both must have the same characters, white space aside, and there must be a word
    for each column, or for all but a first column without a name.
    """
    squashed = lambda a: F.regexp_replace(F.array_join(a, ""), r"(?U)\s+", "")
    rows = row_arrays(cells, key)
    heads = rows.filter("row = 0").join(first_lines.select("doc_id", "page", "names"), ["doc_id", "page"]).filter(squashed("cells") == squashed("names"))
    names = F.when(F.size("names") == F.size("cells"), F.col("names")).when(F.size("names") == F.size("cells") - 1, F.concat(F.array(F.lit("")), "names"))
    heads = heads.select(*key, "row", names.alias("_names")).filter("_names IS NOT NULL")
    out = rows.join(heads, [*key, "row"], "left").withColumn("repaired", F.col("_names").isNotNull() & (F.col("_names") != F.col("cells")))
    return out.select(*key, "row", "repaired", F.posexplode(F.coalesce("_names", "cells")).alias("col", "text"))


def merge_grids(cells: DataFrame, strategies: DataFrame) -> DataFrame:
    """Grids of a document that are one table over several pages: doc_id, part (from 1), page, row (through the whole table), cells.

    ``strategies(doc_id, page, table_id, strategy)``: ``ruled`` or ``text``. A grid goes on with the one before it (by page, then table) when
    both have as many columns and were found the same way and, if ruled, begin with the same row. Rows like the table's first are headers, said
    again on later pages, and are left out there.
    """
    rows = row_arrays(cells, KEY)
    grids = rows.groupBy(*KEY).agg(F.min_by("cells", "row").alias("head")).join(strategies, KEY).withColumn("n_cols", F.size("head"))
    order = Window.partitionBy("doc_id").orderBy("page", "table_id")
    before = lambda c: F.lag(c).over(order)
    goes_on = (F.col("n_cols") == before("n_cols")) & (F.col("strategy") == before("strategy")) & ((F.col("strategy") == "text") | (F.col("head") == before("head")))
    grids = grids.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("part", F.sum("_new").over(order).cast("int"))
    first = grids.filter("_new = 1").select("doc_id", "part", F.col("head").alias("_head"), F.struct("page", "table_id").alias("_first"))
    placed = rows.join(grids.select(*KEY, "part"), KEY).join(first, ["doc_id", "part"])
    kept = placed.filter((F.struct("page", "table_id") == F.col("_first")) | (F.col("cells") != F.col("_head")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("page", "table_id", "row")) - 1
    return kept.select("doc_id", "part", "page", nth.alias("row"), "cells")
