"""Python files cut at their definitions."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .text import chunk_lines

#: Lines of a file's head, characters a definition must have.
HEAD_LINES, LEAST_CHARS = 40, 20


def definitions(source: str) -> list[tuple[str, str, int, int]] | None:
    """Kind, name, first and last line of every function and class, outer ones first; None for what is no Python."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    kinds = {ast.FunctionDef: "FunctionDef", ast.AsyncFunctionDef: "AsyncFunctionDef", ast.ClassDef: "ClassDef"}
    found = {(n.lineno, n.end_lineno or n.lineno): (kinds[type(n)], n.name) for n in ast.walk(tree) if type(n) in kinds}
    return [(*what, *span) for span, what in found.items()]


def python_chunks(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, kind, name, start_line, end_line, content: the head of each file (its first 40 lines) and every function and class, nested ones as well.

    Files that do not parse are cut into windows of lines, and so are those in which nothing is found. Definitions of under 20 characters are left out. A file is
    parsed where it lies; its definitions are cut in Spark.
    """
    ship(files.sparkSession)
    base = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    kind_of_id = dict(base.dtypes)["id"]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(found=[None if (d := definitions(s)) is None else [{"kind": k, "name": n, "first": a, "last": z} for k, n, a, z in d] for s in f["content"]])

    parsed = base.mapInPandas(parse, f"id {kind_of_id}, content string, found array<struct<kind: string, name: string, first: int, last: int>>")
    parsed = parsed.withColumn("lines", F.split(F.regexp_replace("content", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n"))
    cut = lambda first, last: F.trim(F.array_join(F.slice("lines", first, last - first + 1), "\n"))
    blank = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    n = F.size("lines")
    good = parsed.filter("found IS NOT NULL")
    heads = good.select("id", F.lit("module_header").alias("kind"), F.lit("header").alias("name"), F.lit(1).alias("start_line"), F.least(F.lit(HEAD_LINES), n).alias("end_line"), blank(cut(F.lit(1), F.least(F.lit(HEAD_LINES), n))).alias("content")).filter("content <> ''")
    parts = good.select("id", "lines", F.explode("found").alias("d")).select("id", "d.kind", "d.name", F.col("d.first").alias("start_line"), F.col("d.last").alias("end_line"), blank(cut(F.col("d.first"), F.col("d.last"))).alias("content"))
    parts = parts.filter(F.length("content") >= LEAST_CHARS)
    plain = chunk_lines(parsed.filter("found IS NULL"), "id", "content").select("id", F.lit("text_chunk").alias("kind"), F.lit(None).cast("string").alias("name"), "start_line", "end_line", "content")
    return heads.unionByName(parts).unionByName(plain)
