"""From raw documents to packed training sequences, in five written stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's documents. The first four return the columns of `documents`; other
columns of a stage's input go. An empty table stays one. Rows without an id are documents like
any other but for near_duplicates, which leaves them as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridecast.llm import decontamination, language, line_dedup, ngram_join, packing
from ridecast.llm.scratch import give_back_memory, held_out_remainder, read_table, ship, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from four fifths of them.

    Where no row has a language to learn from, nothing can be rejected and all rows stay.
    """
    ship(spark)
    model = language.fit(docs, held_out_remainder(F.col("doc_id"), 5) != 0)
    give_back_memory()  # of the sample, which the driver has learned from
    if model is None:
        return docs.select(*COLUMNS)
    return language.predict(docs, model).where(~F.col("rejected")).select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat an earlier one; documents that had no other line go."""
    ship(spark)
    left = line_dedup.drop_repeated_lines(docs)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, 0.8)."""
    ship(spark)
    groups = ngram_join.join_documents(docs, words=5, num=80, den=100)
    others = written(
        groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_copy")).distinct(), "near-copies"
    )
    return docs.join(others, F.col("doc_id") == F.col("_copy"), "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each decided by its own text."""
    ship(spark)
    items = read_table(spark, sf_dir, "benchmark")
    return decontamination.decontaminate(docs.select(*COLUMNS), items, keep_null_ids=False)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte", end_id=0)


STAGES = [
    ("language_id", language_id),
    ("line_deduplication", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: A trained model, sequence alignment and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
