"""The corpus pipeline: quality, line dedup, near-duplicates, mixing, packing.

Each stage reads what the stage before it wrote and works on all of it; its decisions
take effect in the rows or texts it returns.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.llm import line_dedup, mixing, ngram_join, packing, quality
from behaviorlens.llm.common import shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays within their language's threshold.  Null and empty texts stay; rows that repeat an id are
    judged one by one; a null language has the threshold of all."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line repeats up to one word; n_chars follows the text.  Rows without an id keep their
    text, null texts stay null, a text whose lines all go is empty."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8, the one of the smallest id.  Texts without words and
    rows without an id stay; rows that repeat an id stay or go together."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say.  Texts without words have the prior's posteriors; rows that repeat an id are rounded alike."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))[1]


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens; an empty or null text is its end token alone."""
    return packing.packed(docs, remembered=50_000, slice_bytes=1 << 19)  # four stages before it have filled the executors' memory


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifiers' training and the tokenizer; the stages are tested instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
