"""A corpus pipeline of five operators; each stage works on what its predecessor kept.

quality rules (rejected documents go), near-duplicates (one document of each class stays),
benchmark decontamination (documents with a benchmark window go), secrets (masked in the text),
BPE (counts and digests of the ids and of the decoded text). All stages but the last return the
columns of documents. What a stage returns is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import op01_quality, op04_bpe, op06_near, op07_secrets, op08_decontaminate
from postlake.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the quality rules."""
    return op01_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the smallest id."""
    return op06_near.one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return op08_decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars is that of the new text."""
    out = op07_secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of all documents."""
    return op04_bpe.digests(docs.select("doc_id", "text"), keep_text=False)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("bpe", bpe),
]

#: Near-duplicate classes and BPE can't be expressed in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
