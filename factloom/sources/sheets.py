"""XLSX sheets as typed tables: read by the cluster from any path Spark reads, by runs of rows, only the columns that are asked for.

A workbook is one file, so Spark hands its bytes to as many tasks as there are runs of rows; each inflates its sheet, skips to its run and parses
nothing else. Kinds of cells are counted over all rows, so a column's type never rests on a sample.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import partial
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .workbook import FUNCTION, MAIN, REFERENCE, column_index, safe_name, shared_strings, sheet_paths

#: Rows of a sheet that one task parses; bytes that are inflated at a time.
RUN_ROWS, CHUNK = 50_000, 1 << 20
#: Numbers of the built-in formats that show dates or times; what marks a date in a format of one's own, once quoted text and brackets are gone.
DATE_FORMATS, DATE_MARK, NO_FORMAT = {*range(14, 23), *range(45, 48)}, re.compile(r"[ymdhs]", re.IGNORECASE), re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')
#: Kinds from the one that wins a column down.
RANKED = ("formula", "date", "text", "float", "int", "bool")
TYPES = {"formula": "string", "date": "timestamp", "text": "string", "float": "double", "int": "bigint", "bool": "boolean", "empty": "string"}
ROW = re.compile(rb"<(?:\w+:)?row\b[^>]*?/>|<(?:\w+:)?row\b[^>]*>.*?</(?:\w+:)?row>", re.DOTALL)


def date_styles(book: zipfile.ZipFile) -> tuple[set[int], datetime]:
    """Numbers of the cell styles that show dates, and the day that dates count from."""
    workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
    late = any(p.get("date1904") in ("1", "true") for p in workbook.iter(f"{MAIN}workbookPr"))
    start = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
    if "xl/styles.xml" not in book.namelist():
        return set(), start
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if DATE_MARK.search(NO_FORMAT.sub("", f.get("formatCode") or ""))}
    formats = styles.find(f"{MAIN}cellXfs")
    return {k for k, xf in enumerate(formats if formats is not None else []) if int(xf.get("numFmtId") or 0) in DATE_FORMATS | own}, start


def raw_rows(book: zipfile.ZipFile, part: str, first: int, last: int) -> Iterator[tuple[int, ElementTree.Element]]:
    """Rows ``first`` to ``last`` (exclusive; from 0, the header) of a sheet, as elements without namespaces; others are passed over unparsed."""
    held, n = b"", 0
    with book.open(part) as f:
        while n < last:
            more = f.read(CHUNK)
            held += more
            end = 0
            for m in ROW.finditer(held):
                if first <= n < last:
                    yield n, ElementTree.fromstring(re.sub(rb"(</?)\w+:", rb"\1", m[0]))
                n, end = n + 1, m.end()
            held = held[end:]
            if not more:
                return


def cell_value(c: ElementTree.Element, strings: list[str], dated: set[int], start: datetime) -> tuple[str, str | None, str | None]:
    """Kind, value as text, and formula of a cell. A formula without a stored value is of kind formula."""
    kind, v, f = c.get("t"), c.find("v"), c.find("f")
    formula = None if f is None else f.text or ""
    text = v.text if v is not None else None
    if kind == "inlineStr":
        return "text", "".join(t.text or "" for t in c.iter("t")), formula
    if text is None:
        return ("blank", None, None) if formula is None else ("formula", f"={formula}", formula)
    if kind == "s":
        return "text", strings[int(text)], formula
    if kind in ("str", "e"):
        return "text", text, formula
    if kind == "b":
        return "bool", "true" if text == "1" else "false", formula
    if kind == "d":
        return "date", text, formula
    if int(c.get("s") or 0) in dated:
        return "date", str(start + timedelta(milliseconds=round(float(text) * 86_400_000))), formula
    whole = re.fullmatch(r"-?\d+", text)
    return "int" if whole else "float", text, formula


def parsed(book: zipfile.ZipFile, part: str, first: int, last: int) -> Iterator[tuple[int, dict[int, tuple[str, str | None, str | None]]]]:
    strings, (dated, start) = shared_strings(book), date_styles(book)
    for n, row in raw_rows(book, part, first, last):
        cells, at = {}, 0
        for c in row.iter("c"):
            at = column_index(c.get("r")) if c.get("r") else at
            found = cell_value(c, strings, dated, start)
            if found[0] != "blank":
                cells[at] = found
            at += 1
        yield n, cells


def dimension(book: zipfile.ZipFile, part: str) -> tuple[int, int]:
    """Rows and columns as the sheet states them in its head; counted where it does not."""
    with book.open(part) as f:
        head = f.read(4096)
    if m := re.search(rb'<(?:\w+:)?dimension\b[^>]*\bref="(?:[A-Z]+\d+:)?([A-Z]+)(\d+)"', head):
        return int(m[2]), column_index(m[1].decode()) + 1
    rows = [[column_index(c.get("r")) + 1 if c.get("r") else k + 1 for k, c in enumerate(row.iter("c"))] for _, row in raw_rows(book, part, 0, 1 << 62)]
    return len(rows), max((max(r, default=0) for r in rows), default=0)


def _files(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _list(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for path, content in zip(f["path"], f["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                for k, (name, part) in enumerate(sheet_paths(book).items()):
                    try:
                        n, width = dimension(book, part)
                        first = next(parsed(book, part, 0, 1), (0, {}))[1]
                        heads = [(first.get(i, ("", "", None))[1] or "").strip() or f"col{i + 1}" for i in range(width)]
                        out.append((path, k, name, part, n, width, heads, None))
                    except Exception as e:  # noqa: BLE001  (told in the row; the other sheets go on)
                        out.append((path, k, name, part, 0, 0, [], f"{type(e).__name__}: {e}"[:300]))
        yield pd.DataFrame(out, columns=["path", "position", "sheet", "part", "n_rows", "n_columns", "headers", "error"])


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """path, position, sheet, part, n_rows (with the header), n_columns, headers, error: a row for each sheet, also those that cannot be read."""
    return _files(spark, path).mapInPandas(_list, "path string, position int, sheet string, part string, n_rows long, n_columns long, headers array<string>, error string")


def _runs(spark: SparkSession, path: str, sheets: DataFrame) -> DataFrame:
    """Each sheet's file with each of its runs of rows, dealt to tasks."""
    runs = sheets.filter("error IS NULL AND n_rows > 1").select("path", "sheet", "part", "headers", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows") - 1, F.lit(RUN_ROWS).cast("long"))).alias("first")).withColumn("last", F.col("first") + RUN_ROWS)
    tasks = max(1, runs.count())
    return _files(spark, path).join(runs, "path").repartition(tasks, "path", "sheet", "first")


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for sheet, part, first, last, content in zip(f["sheet"], f["part"], f["first"], f["last"], f["content"], strict=True):
            kinds, formulas, used, links = Counter(), Counter(), Counter(), Counter()
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                for _, cells in parsed(book, part, first, last):
                    for at, (kind, _, formula) in cells.items():
                        kinds[at, kind] += 1
                        if formula is not None:
                            formulas[at] += 1
                            used.update({u.upper() for u in FUNCTION.findall(formula)})
                            links.update({a or b for a, b in REFERENCE.findall(formula)} - {sheet})
            out += [(sheet, at, "kind", kind, n) for (at, kind), n in kinds.items()] + [(sheet, at, "formula", None, n) for at, n in formulas.items()]
            out += [(sheet, None, "function", u, n) for u, n in used.items()] + [(sheet, None, "reference", u, n) for u, n in links.items()]
        yield pd.DataFrame(out, columns=["sheet", "at", "what", "name", "n"]).astype({"at": "Int32"})


def column_kinds(spark: SparkSession, path: str, sheets: DataFrame | None = None) -> DataFrame:
    """sheet, at (from 0), header, kind, n_formulas: of every column; whole and broken numbers together are float, otherwise formula, date and text come first."""
    sheets = list_sheets(spark, path) if sheets is None else sheets
    found = _runs(spark, path, sheets).mapInPandas(_scan, "sheet string, at int, what string, name string, n long")
    per = found.filter("at IS NOT NULL").groupBy("sheet", "at").agg(F.collect_set(F.when(F.col("what") == "kind", F.col("name"))).alias("kinds"), F.coalesce(F.sum(F.when(F.col("what") == "formula", F.col("n"))), F.lit(0)).alias("n_formulas"))
    first = F.get(F.filter(F.array(*[F.lit(k) for k in RANKED]), lambda k: F.array_contains("kinds", k)), 0)
    per = per.withColumn("kind", first)
    heads = sheets.filter("error IS NULL").select("sheet", F.posexplode("headers").alias("at", "header"))
    return heads.join(per, ["sheet", "at"], "left").select("sheet", "at", "header", F.coalesce("kind", F.lit("empty")).alias("kind"), F.coalesce("n_formulas", F.lit(0)).alias("n_formulas"))


def formula_links(spark: SparkSession, path: str) -> DataFrame:
    """sheet, what (function or reference), name and how many formulas have it; references to sheets that the book has."""
    sheets = list_sheets(spark, path)
    found = _runs(spark, path, sheets).mapInPandas(_scan, "sheet string, at int, what string, name string, n long").filter("at IS NULL")
    known = sheets.select(F.col("sheet").alias("_known"))
    named = found.join(known, F.col("name") == F.col("_known"), "left").filter((F.col("what") == "function") | F.col("_known").isNotNull())
    return named.groupBy("sheet", "what", "name").agg(F.sum("n").alias("n"))


def _values(frames: Iterator[pd.DataFrame], wanted: list[int]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for part, first, last, content in zip(f["part"], f["first"], f["last"], f["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                rows = [(n, [cells.get(at, (None, None))[1] for at in wanted]) for n, cells in parsed(book, part, first, last) if cells]
            for at in range(0, len(rows), 5000):
                yield pd.DataFrame(rows[at : at + 5000], columns=["row", "cells"])


def load_sheet(spark: SparkSession, path: str, sheet: str | None = None, columns: list[str] | None = None, cap: int | None = None) -> tuple[DataFrame, dict]:
    """A sheet (the first, unless named) as a typed table of the wanted columns, and what is known of it: rows, columns, whether ``cap`` cut it.

    A column is long, double, boolean, timestamp or text by the kinds of all its cells; cells of other kinds in it are kept as text. Rows without a cell are left
    out. A name that is said twice gets a number. Columns that are not asked for are not parsed into values.
    """
    listed = list_sheets(spark, path)
    one = listed.filter(F.col("sheet") == sheet) if sheet else listed.filter("position = 0")
    head = one.first()
    if head is None or head["error"]:
        raise ValueError(f"no sheet {sheet!r} in {path}" if head is None else f"sheet {head['sheet']!r} cannot be read: {head['error']}")
    seen: Counter = Counter()
    names = []
    for h in head["headers"]:
        seen[h] += 1
        names.append(h if seen[h] == 1 else f"{h}_{seen[h]}")
    if missing := set(columns or ()) - set(names):
        raise ValueError(f"no column {sorted(missing)} in sheet {head['sheet']!r}")
    wanted = [i for i, n in enumerate(names) if columns is None or n in columns]
    kinds = {r["at"]: r["kind"] for r in column_kinds(spark, path, one).collect()}  # a row per column
    body = _runs(spark, path, one).mapInPandas(partial(_values, wanted=wanted), "row long, cells array<string>")
    if cap is not None and head["n_rows"] - 1 > cap:
        body = body.filter(F.col("row") <= cap)
    typed = [F.try_cast(F.col("cells")[k], TYPES[kinds.get(i, "empty")]).alias(names[i]) if hasattr(F, "try_cast") else F.col("cells")[k].try_cast(TYPES[kinds.get(i, "empty")]).alias(names[i]) for k, i in enumerate(wanted)]
    return body.select(*typed), {"rows": head["n_rows"] - 1, "columns": head["n_columns"], "truncated": cap is not None and head["n_rows"] - 1 > cap}


def load_workbook(session, path: str, prefix: str, sheets: list[str] | None = None) -> tuple[list[str], dict[str, str]]:
    """Every sheet (or those named) as ``<prefix>_<sheet>``, the prefix alone for a book of one: the names made, and why others failed."""
    found = list_sheets(session.spark, path).orderBy("position").collect()  # a row per sheet
    made, failed = [], {r["sheet"]: r["error"] for r in found if r["error"]}
    for r in found:
        if r["error"] or (sheets is not None and r["sheet"] not in sheets):
            continue
        name = prefix if len(found) == 1 else f"{prefix}_{safe_name(r['sheet'])}"
        try:
            session.catalog.register(name, load_sheet(session.spark, path, r["sheet"])[0], f"excel:{path}#{r['sheet']}")
            made.append(name)
        except Exception as e:  # noqa: BLE001  (told to the caller; the other sheets go on)
            failed[r["sheet"]] = f"{type(e).__name__}: {e}"[:300]
    return made, failed
