"""A corpus pipeline: quality, line dedup, near-duplicates, mixing, tokens; each stage takes what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import bpe, lineruns, mixing, nearcopies, quality
from docsieve.shared import cut

#: The probability of the better grades from which a document passes.
LEAST_QUALITY = 0.5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the ordinal model, fitted on this stage's rated documents, doesn't reject by their own text."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LEAST_QUALITY)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more are cut; n_chars follows."""
    out = lineruns.dedup_lines(docs)
    length = F.when(F.col("_runs").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumn("n_chars", length).select(docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near copies: 5-word shingles, Jaccard 0.8."""
    return nearcopies.survivors(docs).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights; a document is there as often as it is taken."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [("quality", good), ("lines", distinct_lines), ("near-duplicates", distinct_documents), ("mixing", mixture), ("tokens", tokens)]

#: Models, fingerprints and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
