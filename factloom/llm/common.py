"""Helpers shared by the training-data operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the operators' word and byte rules: blank, tab, newline, vertical tab, form feed, return.
WHITESPACE = " \t\n\x0b\x0c\r"
#: Bytes of rows that Spark hands to a Python worker at once, and code points that a worker takes together.
ARROW_BYTES, CHUNK_CHARS = 8 << 20, 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``. Where it is unset, only a session
    whose executors are this machine's own (``local[...]``) gets a folder; any other is told to set one."""
    sc = spark.sparkContext
    if not (found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors and is read many times."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null as empty); any other columns of ``docs``, of whatever name, stay out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def chunks(values: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of about ``CHUNK_CHARS`` together, so what a worker makes of them is bounded however long texts are."""
    part, size = [], 0
    for v in values:
        part.append(v)
        size += len(v)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once per application; bounds Arrow batches by bytes, as texts may be long."""
    sc, top = spark.sparkContext, Path(__file__).resolve().parents[1]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if getattr(sc, "_factloom_shipped", False):
        return
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{top.name}", "zip", top.parent, top.name)
    sc.addPyFile(made)
    sc._factloom_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key of a row that tells rows of one id (or a null one) but different texts apart; equal rows share it, and all results."""
    known = F.when(F.col(id_col).isNotNull(), F.concat(F.lit("="), F.col(id_col).cast("string")))  # a null id is like no text
    return F.concat_ws(":", F.coalesce(known, F.lit("~")), F.xxhash64(text_col).cast("string"))
