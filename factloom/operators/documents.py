"""Positioned words: lines, segments, column bands, tables, evidence and sections.

Input is ``words(doc_id, page, page_width, word_idx, text, left, top, width, height, size, bold)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Typed patterns of the entity extractor. Only the prefix of a reference number ignores case.
ENTITIES = {
    "gstin": r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z\d]Z[A-Z\d]\b",
    "ifsc_code": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "pan": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.-]*[a-zA-Z]{2,}\b",
    "phone": r"(?<!\d)(?:\+91[-\s]?)?[6-9]\d{9}(?!\d)",
    "website": r"\b(?:https?://|www\.)[\w.-]+\.[a-zA-Z]{2,}[\w/.-]*",
    "invoice_number": r"\b(?i:INV|INVOICE|BILL)(?i:\s*NO\.?)?[-/:\s]?(?=[A-Z0-9\-/]*\d)[A-Z0-9]+(?:[-/][A-Z0-9]+)*\b",
    "po_number": r"\b(?i:P\.?O\.?)(?i:\s*NO\.?)?[-/:\s]?(?=[A-Z0-9\-/]*\d)[A-Z0-9]+(?:[-/][A-Z0-9]+)*\b",
    "date": r"(?i)\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?,?\s+\d{4})\b",
    "amount": r"(?:₹|Rs\.?|INR|\$)\s?\d[\d,]*(?:\.\d{1,2})?|\b\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?\b",
}
#: Of which every match of the patterns above holds one: a digit, an at-sign, or how an address begins.
SIGNS = r"[0-9@]|://|www\."
#: Share of a page's width between edges from which another column begins.
BAND_GAP = 0.25


def entities(df: DataFrame, id_col: str, text_col: str, kinds: list[str] | None = None) -> DataFrame:
    """id, kind and value of every match of the typed patterns."""
    def matches(kind: str) -> Column:
        return F.transform(F.regexp_extract_all(text_col, F.lit(ENTITIES[kind]), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = [matches(k) for k in kinds or ENTITIES]
    return df.select(F.col(id_col).alias("id"), F.explode(F.flatten(F.array(*found))).alias("m")).select("id", "m.*")


def group_lines(words: DataFrame) -> DataFrame:
    """``words`` with ``line``: a word opens a line when its centre is further from the previous word's than half the larger height."""
    w = Window.partitionBy("doc_id", "page").orderBy("top", "left", "word_idx")
    centre = F.col("top") + F.col("height") / 2
    opens = F.abs(centre - F.lag(centre).over(w)) > 0.5 * F.greatest("height", F.lag("height").over(w))
    return words.withColumn("_open", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("line", F.sum("_open").over(w)).drop("_open")


def segments(lined: DataFrame, gap: float = 1.6) -> DataFrame:
    """``segment`` within a line: a gap wider than 1.6 times the line's median height splits, unless a colon stands before it."""
    line = Window.partitionBy("doc_id", "page", "line")
    w = line.orderBy("left", "word_idx")
    rows = lined.withColumns({"_gap": F.col("left") - F.lag(F.col("left") + F.col("width")).over(w), "_colon": F.lag("text").over(w).endswith(":")})
    rows = rows.withColumn("_h", F.percentile("height", 0.5).over(line))  # over the line's own rows, in the order they have
    split = (F.col("_gap") > gap * F.col("_h")) & ~F.col("_colon")
    return rows.withColumn("_split", F.coalesce(split, F.lit(False)).cast("int")).withColumn("segment", F.sum("_split").over(w)).drop("_split", "_h", "_gap", "_colon")


def segment_texts(segmented: DataFrame) -> DataFrame:
    key = ["doc_id", "page", "line", "segment"]
    words = F.transform(F.array_sort(F.collect_list(F.struct("left", "word_idx", "text"))), lambda x: x["text"])
    return segmented.groupBy(*key).agg(F.array_join(words, " ").alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"), F.max("size").alias("size"), F.bool_and("bold").alias("bold"))


def column_bands(segs: DataFrame, page_width: float) -> DataFrame:
    """Left edges of the page's columns: edges at least a quarter page apart open bands."""
    w = Window.partitionBy("doc_id", "page").orderBy("left")
    edges = segs.select("doc_id", "page", "left").distinct()
    opens = F.coalesce(F.col("left") - F.lag("left").over(w) >= BAND_GAP * page_width, F.lit(True))
    band = F.sum(opens.cast("int")).over(w)
    return edges.withColumn("band", band).groupBy("doc_id", "page", "band").agg(F.min("left").alias("left"), F.count("*").alias("n_edges"))


def table_records(cells: DataFrame) -> DataFrame:
    """cells(table_id, row, col, text), row 0 the header -> a map per row; tables whose headers are blank or repeat give none."""
    heads = cells.filter("row = 0").groupBy("table_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("heads"), F.min(F.length(F.trim("text"))).alias("shortest"), (F.count("*") == F.count_distinct("text")).alias("unique")
    )
    rows = cells.filter("row > 0").groupBy("table_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("values"))
    good = heads.filter("unique AND shortest > 0")
    return rows.join(good, "table_id").filter(F.size("heads") == F.size("values")).select("table_id", "row", F.map_from_arrays("heads", "values").alias("record"))


def tabular_test(cells: DataFrame) -> DataFrame:
    """Whether a grid is a table: three rows, rows filled to 0.6 at the (upper) median, and most columns present in most rows."""
    filled = F.trim("text") != ""
    rows = cells.groupBy("table_id", "row").agg(F.avg(filled.cast("double")).alias("fill"))
    per_row = rows.groupBy("table_id").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list("fill")).alias("fills")).select("table_id", "n_rows", F.col("fills")[F.floor(F.size("fills") / 2).cast("int")].alias("median_fill"))
    cols = cells.groupBy("table_id", "col").agg(F.avg(filled.cast("double")).alias("present")).groupBy("table_id").agg(F.avg((F.col("present") >= 0.6).cast("double")).alias("steady_columns"))
    out = per_row.join(cols, "table_id")
    return out.withColumn("tabular", (F.col("n_rows") >= 3) & (F.col("median_fill") >= 0.6) & (F.col("steady_columns") >= 0.6))


def normalise_quote(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s,|]+", "")


def evidence_on_lines(lines: DataFrame, quotes: DataFrame) -> DataFrame:
    """quotes(doc_id, quote_id, quote, page) found within one line of lines(doc_id, page, line, text): the shortest line, cited pages first."""
    said = lines.withColumn("_said", normalise_quote(F.col("text"))).alias("l")  # once a line, not once a pair
    asked = quotes.withColumn("_asked", normalise_quote(F.col("quote"))).filter("_asked <> ''").alias("q")
    hit = said.join(asked, F.col("l.doc_id") == F.col("q.doc_id")).filter(F.contains("_said", F.col("_asked")))
    order = Window.partitionBy("quote_id").orderBy(F.col("cited").desc(), F.length("text"), "page", "line")
    rows = hit.select("q.quote_id", "l.doc_id", "l.page", "l.line", "l.text", (F.col("l.page") == F.col("q.page")).alias("cited"))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def body_size(lines: DataFrame) -> DataFrame:
    """Per document the font size that most characters have (ties: the smallest)."""
    chars = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"))
    return chars.groupBy("doc_id").agg(F.min(F.struct(-F.col("chars"), F.col("size").alias("size"))).alias("m")).select("doc_id", F.col("m.size").alias("body"))


def sections(lines: DataFrame) -> DataFrame:
    """lines with ``heading`` and ``section``: larger than the body by 1.12, or bold, opens a section; what comes before is section 0."""
    rows = lines.join(body_size(lines), "doc_id")
    heading = (F.col("size") >= 1.12 * F.col("body")) | F.col("bold")
    w = Window.partitionBy("doc_id").orderBy("page", "line")
    return rows.withColumn("heading", heading).withColumn("section", F.sum(F.col("heading").cast("int")).over(w))


def cut_word_ratio(cells: DataFrame, words: DataFrame) -> DataFrame:
    """Share of a grid's tokens that are not words of its page: words were cut between cells."""
    tokens = cells.select("table_id", "doc_id", F.explode(F.split(F.trim("text"), r"\s+")).alias("token")).filter("token != ''")
    known = words.select("doc_id", F.col("text").alias("token"), F.lit(1).alias("known")).distinct()
    out = tokens.join(known, ["doc_id", "token"], "left").groupBy("table_id").agg(F.avg(F.col("known").isNull().cast("double")).alias("cut_ratio"))
    return out.withColumn("accepted", F.col("cut_ratio") <= 0.15)


def canonical_box(box: Column) -> Column:
    """xmin, ymin, xmax, ymax within 0..1: values over 2 are thousandths, reversed corners are turned."""
    scale = F.when(F.array_max(box) > 2, 1000.0).otherwise(1.0)
    v = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), box[k] / scale))
    return F.struct(F.least(v(0), v(2)).alias("xmin"), F.least(v(1), v(3)).alias("ymin"), F.greatest(v(0), v(2)).alias("xmax"), F.greatest(v(1), v(3)).alias("ymax"))


def transcript_windows(df: DataFrame, by: str, start: str, text_col: str, seconds: float = 60.0) -> DataFrame:
    """Transcript parts in windows anchored at their first part; the anchor moves on, so each recording is scanned in order."""
    import pandas as pd

    ship(df.sparkSession)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, anchor = [], None
        for s, x in pdf.sort_values(start)[[start, text_col]].itertuples(index=False):
            if anchor is None or s - anchor > seconds:
                anchor = s
                rows.append([pdf[by].iloc[0], s, []])
            rows[-1][2].append(x)
        return pd.DataFrame([(k, s, " ".join(t)) for k, s, t in rows], columns=["key", "start", "text"])

    return df.select(by, start, text_col).groupBy(by).applyInPandas(scan, f"key {dict(df.dtypes)[by]}, start {dict(df.dtypes)[start]}, text string")
