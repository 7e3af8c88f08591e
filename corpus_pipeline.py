"""A corpus pipeline: toxic texts, near copies, repeated strings and benchmark leaks go, the rest is packed.

Each stage takes (spark, docs, sf_dir), with docs the table that the stage before it wrote, and works on all of it.
All stages but the last return the columns of documents, whatever these are; the last returns the packed pieces. Null and
empty texts pass through all stages and are packed as one token. Rows without doc_id are never dropped as copies or
leaks. Empty tables stay empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontamination, near_dedup, packing, suffix_dedup, toxicity
from sparkloom.llm.common import new_folder, read


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that score 0.5 or more, each by its own text. Learns from labels outside the held-out fifth."""
    return toxicity.clean(docs, read(spark, sf_dir, "labels").filter(~toxicity.held_out()))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies: five words, similarity 0.8. Of rows that
    are equal in doc_id and text one stays; those with one doc_id and other texts stay or go together."""
    return near_dedup.without_near_duplicates(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes or more that occur elsewhere out of the texts; all documents stay."""
    return suffix_dedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 80 % of the five-word shingles of a benchmark item."""
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_texts),
    ("minhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", packed),
]

#: Trained models, MinHash components and packings are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
