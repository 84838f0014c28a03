"""The corpus pipeline: STAGES applied in order to ``documents``.

Quality filter, exact dedup, near-duplicate removal, mixing to target
weights, packing.  Each stage works on all rows its predecessor kept, is
written as Parquet into the cluster's shared checkpoint folder and read
again, so a lost executor never recomputes an earlier stage.  All stages but
the last return the columns of their input.

Defined results: an empty table passes through every stage; null texts have
no words (the classifier decides on them, equal ones collapse, mixing takes
none of them); repeated rows collapse in exact dedup; extra columns pass
through to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dealscope.llm import op1_packing, op2_ngram_jaccard, op7_exact_dedup, op9_mixing, op10_quality_classifier
from dealscope.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    return op10_quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return op7_exact_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return op2_ngram_jaccard.drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its source's rate takes it."""
    return op9_mixing.expand(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their token ids."""
    return op1_packing.pack(docs, ranks_file=str(op1_packing.vocabulary()))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all its predecessor kept, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = f"{checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: the classifier is trained and the tokens are BPE ids; the stages
#: are tested one by one against brute force.
ORACLE_SQL = None
