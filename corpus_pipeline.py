"""A training corpus from `documents`: language, exact copies, near copies, benchmark passages, mixture.

Each stage takes what its predecessor kept, reads all of it, and returns the documents that stay with all their columns;
the last returns each document as often as the mixture takes it, numbered in the column copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from llm import decontaminate, exact, language, mixture, neardup
from llm.cluster import ROW, keyed, saved, ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language fits."""
    ship(spark)
    return language.known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    ship(spark)
    return exact.distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more in shingles of five words."""
    ship(spark)
    return neardup.one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window of ten words."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: its columns and copy, from 1 on."""
    ship(spark)
    names, docs = docs.columns, keyed(docs)
    taken = mixture.mix(docs, doc_id=ROW).where("copies > 0").select(F.col("doc_id").alias(ROW), F.col("copies").alias("_copies"))
    return docs.join(taken, ROW).select(*[docs[c] for c in names], F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("copy"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
]

#: Language scores and Newton steps are not for SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
