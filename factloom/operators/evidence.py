"""Stored lines of a page, and quotes found on one line, across lines, or in the cells of a table's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import BAND_GAP, normalise_quote

#: Lines that a quote may run over; share of a page's width from which two segments are columns, not cells; words of prose;
#: tokens of a quote that is looked for in tables, and the share of them that cells (not headers) must give.
LINE_SPAN, COLUMN_GAP, PROSE_WORDS, TABLE_TOKENS, CELL_SHARE = 4, 0.40, 6, 2, 0.5
#: In place of a cell's number where a header stands: larger than any.
NO_CELL = 1 << 30


def store_lines(segs: DataFrame, tables: DataFrame | None = None, page_width: float = 1000.0) -> DataFrame:
    """doc_id, page, line_id (``p1:L1``), column and text: the numbered lines that citations name.

    ``segs`` as ``segment_texts`` gives them; ``tables(doc_id, page, table, x0, y0, x1, y1)`` are ruled grids. Neighbouring segments of a
    line are cells of one row (joined by `` | ``) in one table, or outside of tables when they stand close and are not both prose. Pages without
    tables are read column by column.
    """
    key = ["doc_id", "page"]
    rows = segs.withColumns({"_x": (F.col("left") + F.col("right")) / 2, "_y": (F.col("top") + F.col("bottom")) / 2})
    if tables is not None:
        corners = ["x0", "y0", "x1", "y1"]
        ruled = tables.groupBy(*key).agg(F.collect_list(F.struct("table", *corners)).alias("_tables"))  # a page has few
        inside = lambda t: (F.col("_x") >= t["x0"] - 1) & (F.col("_x") <= t["x1"] + 1) & (F.col("_y") >= t["y0"] - 1) & (F.col("_y") <= t["y1"] + 1)
        rows = rows.join(ruled, key, "left").withColumn("table", F.array_min(F.transform(F.filter("_tables", inside), lambda t: t["table"]))).drop("_tables")
    else:
        rows = rows.withColumn("table", F.lit(None).cast("int"))
    w = Window.partitionBy(*key, "line").orderBy("left", "segment")
    before = lambda c: F.lag(c).over(w)
    prose = F.size(F.split(F.trim("text"), r"\s+")) > PROSE_WORDS
    near = (F.col("left") - before("right") < COLUMN_GAP * page_width) & ~(prose & before(prose))
    same = F.when(F.col("table").isNotNull() | before("table").isNotNull(), F.coalesce(F.col("table") == before("table"), F.col("table").isNull() != before("table").isNull()) & (F.coalesce(F.col("table") == before("table"), F.lit(False)) | near)).otherwise(near)
    rows = rows.withColumn("_cut", F.coalesce(~same, F.lit(True)).cast("int")).withColumn("_row", F.sum("_cut").over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("left", "segment", "text"))), lambda x: x["text"])
    lines = rows.groupBy(*key, "line", "_row").agg(F.array_join(parts, " | ").alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("table").isNotNull().alias("_tabled"))
    # The nearest of the page's bands (``column_bands``), found on the page itself: a page has few edges.
    page = Window.partitionBy(*key)
    edges = F.array_sort(F.collect_set("left").over(page))
    placed = lines.withColumn("_edges", edges).withColumn("_bands", F.filter("_edges", lambda x, i: (i == 0) | (x - F.get(F.col("_edges"), i - 1) >= BAND_GAP * page_width)))
    nearest = F.array_min(F.transform("_bands", lambda x, i: F.struct(F.abs(F.col("left") - x).alias("away"), (i + 1).alias("band"))))
    placed = placed.withColumn("band", nearest["band"]).drop("_edges", "_bands")
    column = F.when(F.max("_tabled").over(page), 1).otherwise(F.col("band"))
    placed = placed.withColumn("column", column.cast("int"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("column", "top", "line", "left"))
    return placed.select(*key, F.concat(F.lit("p"), "page", F.lit(":L"), nth).alias("line_id"), nth.alias("nth"), "column", "text")


def evidence_across_lines(lines: DataFrame, quotes: DataFrame, span: int = LINE_SPAN) -> DataFrame:
    """quotes(quote_id, doc_id, page, nth, quote) found from the cited line on: quote_id, doc_id, page, nth, n_lines (the fewest), text.

    ``lines`` as ``store_lines`` gives them. A window has at most ``span`` lines of one column; one line is the plain case.
    """
    w, line = Window.partitionBy("doc_id", "page").orderBy("nth"), ["doc_id", "page", "nth"]
    said = lines.select(*line, F.struct("text", "column", normalise_quote(F.col("text")).alias("said")).alias("l0"))  # once a line, not once a quote and window
    rows = said.withColumns({f"l{k}": F.lead("l0", k).over(w) for k in range(1, span)})
    q = quotes.select("quote_id", *line, normalise_quote(F.col("quote")).alias("want")).filter("want <> ''").dropna(subset=line)
    q = q.groupBy(*line).agg(F.collect_list(F.struct("quote_id", "want")).alias("asked"))
    # A line and what cites it meet in a window, not a join: where both are dealt by page or document already, neither is dealt again.
    rows = rows.unionByName(q, allowMissingColumns=True).withColumn("asked", F.first("asked", ignorenulls=True).over(Window.partitionBy(*line)))
    rows = rows.filter("l0 IS NOT NULL AND asked IS NOT NULL").select("*", F.explode("asked").alias("a")).select("a.*", *line, *[f"l{k}" for k in range(span)])
    # The lines of the cited one's column, up to the first of another; the shortest run of them that holds the quote.
    goes_on, text = F.lit(True), F.coalesce("l0.said", F.lit(""))
    n, said_so_far = F.when(F.contains(text, F.col("want")), 1), [F.col("l0.text")]
    for k in range(1, span):
        goes_on = goes_on & F.col(f"l{k}").isNotNull() & F.coalesce(F.col(f"l{k}.column") == F.col("l0.column"), F.lit(True))
        text = F.concat(text, F.coalesce(f"l{k}.said", F.lit("")))
        n = n.when(goes_on & F.contains(text, F.col("want")), k + 1)
        said_so_far.append(F.when(F.col("n_lines") > k, F.col(f"l{k}.text")))
    return rows.withColumn("n_lines", n).filter("n_lines IS NOT NULL").select("quote_id", *line, "n_lines", F.concat_ws(" ", *said_so_far).alias("text"))


def tokens(c: Column) -> Column:
    """Runs of letters a-z and digits, in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def spelled(want: Column, cells: Column, heads: Column) -> Column:
    """The cells (places from 0) that a quote's tokens are made of, null if they are not.

    What can stand at each place of the quote is worked out for all places at once: of every cell the longest beginning that is written there, or all that is
    left if the cell holds it anywhere, and of headers whole ones. The longest counts, a cell before a header. From the first place on these lengths lead to the
    end, or the quote is not made of this row; half of its tokens at least must come from cells.
    """
    inside = lambda cell, rest: F.contains(F.concat(F.lit(" "), F.array_join(cell, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(rest, " "), F.lit(" ")))

    def at(p: Column) -> Column:
        rest = F.slice(want, p, F.size(want))
        begun = lambda c: F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(c), F.size(rest))), lambda k: F.slice(rest, 1, k) == F.slice(c, 1, k)))
        by_cell = F.transform(cells, lambda c, i: F.struct(F.when(F.size(c) == 0, 0).when(inside(c, rest), F.size(rest)).otherwise(begun(c)).alias("n"), (-i).alias("place")))
        whole = F.transform(F.filter(heads, lambda h: (F.size(h) > 0) & (F.slice(rest, 1, F.size(h)) == h)), lambda h: F.struct(F.size(h).alias("n"), F.lit(-NO_CELL).alias("place")))
        return F.array_max(F.concat(by_cell, whole))

    steps = F.transform(F.sequence(F.lit(1), F.size(want)), at)
    start = F.struct(F.lit(1).alias("p"), F.lit(0).alias("given"), F.array().cast("array<int>").alias("used"))

    def go(got: Column, i: Column) -> Column:
        step = F.get(steps, got["p"] - 1)
        here, cell = (got["p"] == i) & (step["n"] > 0), step["place"] > -NO_CELL
        used = F.when(cell & ~F.array_contains(got["used"], -step["place"]), F.concat(got["used"], F.array(-step["place"]))).otherwise(got["used"])
        return F.when(here, F.struct((got["p"] + step["n"]).alias("p"), (got["given"] + F.when(cell, step["n"]).otherwise(0)).alias("given"), used.alias("used"))).otherwise(got)

    return F.aggregate(F.sequence(F.lit(1), F.size(want)), start, go, lambda got: F.when((got["p"] == F.size(want) + 1) & (F.size(got["used"]) > 0) & (got["given"] >= CELL_SHARE * F.size(want)), got["used"]))


def evidence_in_tables(cells: DataFrame, quotes: DataFrame) -> DataFrame:
    """quotes(quote_id, doc_id, page, quote) made of one row's cells: quote_id, doc_id, page, table_id, row, columns.

    ``cells(doc_id, page, table_id, row, col, text)``, row 0 the header. Cited pages come first, then pages, tables and rows in order. A quote meets
    only the rows of its document that have the rarest of its tokens (in a cell or a header): every token of a quote has to be in its row.
    """
    key = ["doc_id", "page", "table_id"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("col", tokens(F.col("text")).alias("t")))), lambda x: x["t"])
    heads = cells.filter("row = 0").groupBy(*key).agg(listed.alias("heads"))
    rows = cells.filter("row > 0").groupBy(*key, "row").agg(listed.alias("cells")).join(heads, key, "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<array<string>>")))
    q = quotes.select("quote_id", "doc_id", F.col("page").alias("q_page"), tokens(F.col("quote")).alias("want")).filter(F.size("want") >= TABLE_TOKENS)
    posted = rows.select(*key, "row", F.explode(F.array_distinct(F.flatten(F.concat("cells", "heads")))).alias("token"))
    asked = q.select("quote_id", "doc_id", F.explode(F.array_distinct("want")).alias("token"))
    often = posted.join(asked.select("doc_id", "token").distinct(), ["doc_id", "token"], "left_semi").groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    rarest = asked.join(often, ["doc_id", "token"]).groupBy("quote_id", "doc_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    pairs = posted.join(rarest, ["doc_id", "token"]).drop("token").join(q.drop("doc_id"), "quote_id").join(rows, [*key, "row"])
    pairs = pairs.filter(F.size(F.array_except("want", F.flatten(F.concat("cells", "heads")))) == 0)
    hits = pairs.withColumn("columns", spelled(F.col("want"), F.col("cells"), F.col("heads"))).filter("columns IS NOT NULL")
    order = Window.partitionBy("quote_id").orderBy((F.col("page") == F.col("q_page")).desc(), "page", "table_id", "row")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("quote_id", *key, "row", "columns")


def resolve_evidence(lines: DataFrame, cells: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each quote with the strategy that finds it, tried in order: line, multiline, table, none."""
    across = evidence_across_lines(lines, quotes).select("quote_id", F.when(F.col("n_lines") == 1, "line").otherwise("multiline").alias("by_lines"))
    table = evidence_in_tables(cells, quotes).select("quote_id", F.lit("table").alias("by_cells"))
    out = quotes.join(across, "quote_id", "left").join(table, "quote_id", "left")
    return out.withColumn("strategy", F.coalesce("by_lines", "by_cells", F.lit("none"))).drop("by_lines", "by_cells")
