"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``.

Defined cases: a null or empty text fails the quality rules and goes; a null language is judged by the nearest
reference; rows are known to near-dedup by doc_id and text, so of repeated rows one stays, unlike texts under one
doc_id are judged apart, and rows with a null doc_id stay; of a group the row of least doc_id stays, on a tie the
text of least hash; a null or empty benchmark drops nothing; very long texts are worked on whole and cut into pieces
only by packing; an empty table gives no rows; extra columns are carried up to packing, which does not read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtrace.llm import decontamination, packing, pii, quality_rules, simhash
from loomtrace.llm.tokens import default_tokenizer
from loomtrace.runtime import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of least doc_id."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes typed placeholders."""
    return pii.redact_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return packing.pack_documents(docs, default_tokenizer())


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("personal data", redact), ("packing", pack)]

#: Tokens and XXH64 fingerprints are beyond SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{k}")
    return docs
