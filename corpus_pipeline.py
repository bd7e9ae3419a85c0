"""Corpus pipeline: stages over ``documents``, each written and read again.

Every stage reads all rows that the one before kept and returns the columns
of its input, but for the last, which returns the pieces of packed sequences.
Null texts count as empty; rows with a null id are kept by the filters unless
their text is a copy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm.common import run_path, save, table
from adlens.llm.exact_dedup import keep_exact
from adlens.llm.fair_mix import take_copies
from adlens.llm.packing import pack_documents
from adlens.llm.toxicity import toxicity_scores
from adlens.llm.vertical_join import ngram_join


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not among ``ids`` (a column _gone)."""
    return docs.join(ids, docs["doc_id"] == ids["_gone"], "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels"), "toxic")
    gone = scores.where("predicted = 1").select(F.col("doc_id").alias("_gone")).distinct()
    return without(docs, save(gone, "toxic-gone"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return keep_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (linked five-word shingle sets) the document with
    the smallest id stays."""
    near = ngram_join(docs, width=5, num=80, den=100)
    gone = near.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return without(docs, save(gone, "near-gone"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, once per taken copy.  Documents without a word
    are not taken."""
    return take_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, seq_len=1024)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("fair_mix", mix_stage),
    ("packing", packing_stage),
]

#: Toxicity, shuffled queues over its result and tokenising have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = run_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
