"""XLSX workbooks with the standard library: structure, formulas, cross-sheet references, and a Spark data source."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: The namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REFERENCE = re.compile(r"(?:'([^']+)'|([A-Za-z_][\w.]*))!\$?(?:[A-Z]{1,3}\$?\d*|\d+)")
FUNCTION = re.compile(r"([A-Z][A-Z0-9.]*)\(", re.IGNORECASE)


def sheet_paths(book: zipfile.ZipFile) -> dict[str, str]:
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return {s.get("name"): "xl/" + rels[s.get(f"{REL}id")].removeprefix("/xl/") for s in sheets}


def column_index(cell: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", cell)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]


def rows(path: str, sheet: str) -> Iterator[list[tuple[str | None, str | None]]]:
    """(value, formula) of each cell, a row at a time; rows are streamed and dropped once read."""
    with zipfile.ZipFile(path) as book:
        strings = shared_strings(book)
        with book.open(sheet_paths(book)[sheet]) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                out: list[tuple[str | None, str | None]] = []
                for c in row.iter(f"{MAIN}c"):
                    at = column_index(c.get("r")) if c.get("r") else len(out)
                    out += [(None, None)] * (at - len(out))
                    v, formula = c.find(f"{MAIN}v"), c.find(f"{MAIN}f")
                    text = v.text if v is not None else None
                    if c.get("t") == "s" and text is not None:
                        text = strings[int(text)]
                    elif c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    out.append((text, formula.text if formula is not None else None))
                yield out
                row.clear()


def header(path: str, sheet: str) -> list[str]:
    first = next(rows(path, sheet), [])
    return [(v or "").strip() or f"col{i}" for i, (v, _) in enumerate(first)]


def safe_name(sheet: str) -> str:
    name = re.sub(r"\W+", "_", sheet).strip("_").lower() or "sheet"
    return f"s_{name}" if name[0].isdigit() else name


def inspect(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sheets(sheet, n_rows, n_columns), formulas(sheet, n, functions), dependencies(sheet, refers_to)."""
    sheets, formulas, links = [], [], set()
    with zipfile.ZipFile(path) as book:
        names = list(sheet_paths(book))
    for name in names:
        n, width, used, found = 0, 0, set(), 0
        for row in rows(path, name):
            n, width = n + 1, max(width, len(row))
            for _, formula in row:
                if formula:
                    found += 1
                    used |= {f.upper() for f in FUNCTION.findall(formula)}
                    links |= {(name, a or b) for a, b in REFERENCE.findall(formula) if (a or b) in names and (a or b) != name}
        sheets.append((name, n, width))
        formulas.append((name, found, sorted(used)))
    return (
        spark.createDataFrame(sheets, "sheet string, n_rows long, n_columns long"),
        spark.createDataFrame(formulas, "sheet string, n long, functions array<string>"),
        spark.createDataFrame(sorted(links), "sheet string, refers_to string"),
    )


def shared_columns(path: str, spark: SparkSession) -> DataFrame:
    """Headers that more than one sheet has: candidates for joins."""
    with zipfile.ZipFile(path) as book:
        names = list(sheet_paths(book))
    from pyspark.sql import functions as F

    heads = spark.createDataFrame([(s, c) for s in names for c in header(path, s)], "sheet string, header string")
    return heads.groupBy(F.lower(F.trim("header")).alias("header")).agg(F.sort_array(F.collect_set("sheet")).alias("sheets")).filter(F.size("sheets") > 1)


class SheetPartition(InputPartition):
    def __init__(self, sheet: str):
        self.value = sheet


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str, width: int):
        self.path, self.sheet, self.width = path, sheet, width

    def partitions(self):
        return [SheetPartition(self.sheet)]

    def read(self, partition):
        body = rows(self.path, partition.value)
        next(body, None)
        for row in body:
            values = [v for v, _ in row][: self.width]
            yield tuple(values + [None] * (self.width - len(values)))


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("path", p).option("sheet", s)``: every column as text."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return StructType([StructField(c, StringType()) for c in header(self.options["path"], self.options["sheet"])])

    def reader(self, schema):
        return WorkbookReader(self.options["path"], self.options["sheet"], len(schema))


def load_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").option("path", path).option("sheet", sheet).load()
