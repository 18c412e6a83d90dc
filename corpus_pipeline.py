"""Training-corpus pipeline: quality rules, near-duplicates, secrets, source mixing, SentencePiece encoding.

Each stage works on all that the one before kept, is written as Parquet and read again. All but the last return the
columns of ``documents``; the last returns one row per document that the mix takes (a document taken in two epochs has
two rows) with the size and digest of its encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import dartminhash, mixing, quality, secret_scan
from lotwise.llm.common import read, stage
from lotwise.llm.queries import sentence_pieces


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules and the log-likelihood ratio keep."""
    trusted = quality.trusted_documents(read(spark, sf_dir, "labels"))
    judged = quality.judge(docs, trusted)
    # Written before the filter: pushed down, the filter would work the verdict out again for each of its parts.
    judged = stage(judged.select(*docs.columns, judged.quality.kept.alias("_kept")))
    return judged.where("_kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return dartminhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by their kind; n_chars follows."""
    found = secret_scan.scan(docs)
    found = found.withColumn("text", secret_scan.redact(F.col("text"), F.col("secrets")))
    size = F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", size).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once per epoch of its source that takes it; none is left out."""
    return mixing.realise(docs, mixing.plan(stage(mixing.sized(docs)))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words, pieces, digest of the ids and exactness of the round trip of every row."""
    return sentence_pieces(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]
# Hashed n-grams, signatures and merges can't be written in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
