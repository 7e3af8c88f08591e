"""Benchmark decontamination: test items that occur in documents are found by MinHash containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import containment
from sparkloom.llm.common import all_columns, read


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_item, n_found, containment, first_word for each benchmark item found in a document.

    See containment.contained for what counts as found and for nulls, short texts and repeated rows."""
    return containment.contained(docs, benchmark, words, percent)


def without_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns. Rows without doc_id stay; rows with one doc_id
    are one document, and go if an item is in one of their texts."""
    found = leaks(docs, benchmark, words, percent).select(F.col("doc_id").alias("leaking_id")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("leaking_id"), "left_anti").select(all_columns(docs))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leaks() of all documents and benchmark items: null, empty and short texts hold nothing, repeated rows count once,
    no rows give none."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = containment.sql("benchmark")
