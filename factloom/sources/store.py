"""A store of parsed documents: what has been parsed is known by its content and is not parsed again.

One folder, on any path Spark can write to, holds ``lines/run=<id>``, the parsed lines of one ingest, and ``manifest``, a row for each document. The manifest is
written last, so a run that was lost halfway is invisible, and readers take only lines of runs that it names. A file that changes gets a
new id under its name; ``forget`` adds a row that takes a document out. Two ingests of one document at once leave two rows, of which the first counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.fields import content_id

LINES = "doc_id string, page int, line int, text string"
MANIFEST = "doc_id string, name string, sha256 string, run string, n_pages int, n_lines long, gone boolean, at timestamp"


def plain_lines(files: DataFrame) -> DataFrame:
    """Lines of texts; a form feed begins a page."""
    pages = files.select("doc_id", F.posexplode(F.split(F.col("content").cast("string"), "\f")).alias("page", "t"))
    return pages.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode(F.split("t", r"\r?\n")).alias("line", "text")).select("doc_id", "page", (F.col("line") + 1).alias("line"), "text")


class DocumentStore:
    def __init__(self, spark: SparkSession, path: str, parser: Callable[[DataFrame], DataFrame] = plain_lines):
        """``parser``: files(doc_id, name, content) to lines(doc_id, page, line, text)."""
        self.spark, self.path, self.parser = spark, path.rstrip("/"), parser
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _rows(self) -> DataFrame:
        at = f"{self.path}/manifest"
        return self.spark.read.schema(MANIFEST).parquet(at) if self._fs.exists(self._at(at)) else self.spark.createDataFrame([], MANIFEST)

    def documents(self) -> DataFrame:
        """doc_id, name, sha256, run, n_pages, n_lines, at of what the store holds."""
        order = Window.partitionBy("doc_id").orderBy(F.desc("gone"), "at", "run")
        latest = Window.partitionBy("doc_id").orderBy(F.desc("at"), "run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = self._rows().withColumn("_gone", F.first("gone").over(latest)).filter("NOT _gone AND NOT gone")
        return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_gone", "gone")

    def ingest(self, files: DataFrame) -> dict[str, int]:
        """Parses what is new among files(name, content) and publishes it: how many were given, new and known. Files of one name and content are one."""
        found = files.select("name", F.col("content").cast("binary").alias("content")).withColumn("doc_id", content_id(F.col("name"), F.col("content"))).dropDuplicates(["doc_id"])
        given = found.count()
        new = found.join(self.documents().select("doc_id"), "doc_id", "left_anti")
        n = new.count()
        if n:
            run = uuid.uuid4().hex
            self.parser(new).select("doc_id", "page", "line", "text").write.parquet(f"{self.path}/lines/run={run}")
            made = self.spark.read.schema(LINES).parquet(f"{self.path}/lines/run={run}")
            sizes = made.groupBy("doc_id").agg(F.count_distinct("page").cast("int").alias("n_pages"), F.count("*").alias("n_lines"))
            rows = new.select("doc_id", "name", F.sha2("content", 256).alias("sha256"), F.lit(run).alias("run")).join(sizes, "doc_id", "left")
            rows = rows.select("doc_id", "name", "sha256", "run", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.lit(False).alias("gone"), F.current_timestamp().alias("at"))
            rows.write.mode("append").parquet(f"{self.path}/manifest")  # from here on the run can be seen
        return {"given": given, "new": n, "known": given - n}

    def forget(self, doc_ids: list[str]) -> None:
        rows = self.documents().filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "name", "sha256", "run", "n_pages", "n_lines", F.lit(True).alias("gone"), F.current_timestamp().alias("at"))
        rows.write.mode("append").parquet(f"{self.path}/manifest")

    def lines(self, doc_ids: list[str] | None = None) -> DataFrame:
        """doc_id, page, line, text of documents that the manifest has; only their runs are read."""
        known = self.documents().select("doc_id", "run")
        if doc_ids is not None:
            known = known.filter(F.col("doc_id").isin(doc_ids))
        if not self._fs.exists(self._at(f"{self.path}/lines")):
            return self.spark.createDataFrame([], LINES)
        rows = self.spark.read.schema(LINES + ", run string").option("basePath", f"{self.path}/lines").parquet(f"{self.path}/lines")
        return rows.join(known, ["doc_id", "run"]).drop("run")
