"""From documents to training sequences: rules, near duplicates, secrets, mixing, packing.

A stage takes what its predecessor kept and, but for the last, returns the columns of
documents. Every stage is written to the folder that the cluster shares and read again, so a
lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import jaccard, mixing, packing, rules, secrets
from meterline.llm.common import scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle, and the least similarity in percent, of near duplicates.
SHINGLE, PERCENT = 5, 80


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now has them."""
    return df.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject, and without the lines above the limits in the others."""
    kept = rules.apply_rules(docs.select(*COLUMNS)).where("kept")
    return _documents(kept.withColumn("text", F.col("clean_text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return jaccard.one_of_each(docs.select(*COLUMNS), PERCENT, SHINGLE)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of every secret."""
    ledger = secrets.BlobLedger(spark, scratch(spark, "ledger"))
    ledger.ingest(docs, batch=0)
    found = ledger.on_paths(docs)
    return _documents(found.withColumn("text", secrets.redacted(F.col("text"), F.col("found"))))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated towards the target weights of their sources, dealt out anew."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, packing.public_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: Tokenising is beyond SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    at = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
