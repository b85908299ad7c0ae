"""The training-data pipeline: from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return
the columns of ``documents``. ``run`` writes each stage's result as Parquet below the folder that
``spark.checkpoint.dir`` names and reads it again, so that a lost executor costs one stage's tasks only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrove.llm import langid, line_dedup, prefix_join, queries, tiling


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (no letter, or words that none of the languages makes likely) go; a missing
    language is filled in."""
    told = langid.spoken(docs, docs.columns)
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate lines one stays; a document of which no line is left goes."""
    kept = line_dedup.LineDedup(docs).deduplicated().filter((F.col("n_removed") == 0) | F.col("text").rlike(r"(?U)\S"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar 5-word shingles one stays."""
    return prefix_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    return tiling.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))[1]


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return queries.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicate_lines", near_duplicate_lines),
    ("near_duplicate_documents", near_duplicate_documents),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: The stages hash, estimate and tokenize; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="pipeline-")
    folder = f"{root.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
