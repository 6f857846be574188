"""Stages from raw documents to token ids, each over all that its predecessor kept.

All but the last return the columns of documents. What each stage decides:
quality rules drop documents, near-duplicates leave one document a group, secrets
are masked in the text, sources are mixed to weights by repeating or leaving out
documents, and what is left is encoded and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.common import written
from grovekit.llm.mixing import mix_documents
from grovekit.llm.pieces import encode_decode
from grovekit.llm.quality import quality_filter
from grovekit.llm.secrets import mask_secrets
from grovekit.llm.simhash import simhash_firsts

#: DuckDB has neither XXH64 with a seed nor the tokenizer; tests hold run() against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (op10's: 3-word shingles, 3 bits) one row, that of the smallest id; rows without an id come last."""
    return simhash_firsts(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text."""
    masked = mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every row, and the text that they decode to."""
    return encode_decode(docs, id_cols=("doc_id", "source"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"pipeline-{name}")
    return docs
