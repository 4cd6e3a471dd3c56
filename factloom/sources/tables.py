"""CSV, Parquet, JSON, JDBC and cloud URIs in; Parquet and CSV out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.frames import nan_to_null


def load_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, row_cap: int | None = None) -> DataFrame:
    """Header row expected; types are inferred unless a schema is given. ``row_cap`` keeps as many rows, for a record of truncation."""
    reader = spark.read.option("header", True)
    df = nan_to_null((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))
    return first_rows(df, row_cap) if row_cap else df


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first rows of files read: by file name, place in the file, and order of reading."""
    place = ["_file", "_block", "_place"]
    rows = df.withColumns({"_file": F.input_file_name(), "_block": F.input_file_block_start(), "_place": F.monotonically_increasing_id()})
    return rows.orderBy(*place).limit(n).drop(*place)


def truncation_of(whole: DataFrame, row_cap: int) -> dict | None:
    total = whole.count()
    return {"rows_read": row_cap, "rows_total": total, "strategy": "first rows"} if total > row_cap else None


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def load_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return nan_to_null(spark.read.option("multiLine", multi_line).json(path))


def load_sql(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query passed through to a JDBC database."""
    return nan_to_null(spark.read.format("jdbc").options(url=url, query=query, **options).load())


def load_uri(spark: SparkSession, uri: str) -> DataFrame:
    """Any URI that Hadoop's file systems know: Parquet by its ending, else CSV."""
    return load_parquet(spark, uri) if uri.rstrip("/").endswith(".parquet") else load_csv(spark, uri)


def save(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet by its ending, else CSV."""
    if path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).option("header", True).csv(path)
    return path


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    return (df.orderBy(*order_by) if order_by else df).limit(n)
