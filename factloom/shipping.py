"""This package's code for executors that do not have it installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python, once per application."""
    sc, top = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_factloom_shipped", False):
        return
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{top.name}", "zip", top.parent, top.name))
    sc._factloom_shipped = True
