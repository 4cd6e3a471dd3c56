"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common, decontam, exact_dedup, language, near_dedup, packing

#: Below this share of trigrams that the chosen language holds, a text is taken for none of the known languages.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay; null and empty texts, and texts without a letter, are in none and go.

    Repeated rows share their result; very long texts are read whole. A tie goes to the language first in order, so it stays.
    Of 10,000 labelled documents of the small tables the least score takes one, of two characters.
    """
    common.ship(spark)
    names = (f"lang_pred_{uuid.uuid4().hex}", f"score_{uuid.uuid4().hex}")  # whatever columns documents have
    scored = language.identify(docs, language.fit(docs), names=names)
    return scored.filter((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space aside) stays: the longest, then of least doc_id; of repeated rows one.

    Null and empty texts are equal to each other; a null doc_id comes last.
    """
    common.ship(spark)
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays: that of least doc_id.

    Null and empty texts link with nothing and stay, and so do rows of a null doc_id. Repeated rows (one id and text) stay or go together; very
    long texts are compared whole.
    """
    common.ship(spark)
    return near_dedup.representatives(docs, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; an empty benchmark takes nothing away. Repeated rows stay or go
    together; every place of a very long text is looked at."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, with their places in sequences. A null or empty text is its end id; ties go by doc_id and piece."""
    common.ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Bloom filters, shingle components and tokenization are beyond SQL; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
