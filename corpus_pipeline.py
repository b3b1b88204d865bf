"""Documents in, token ids out: reject, deduplicate, decontaminate, redact, encode.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and its result is written and read again as
the next stage's documents. All but the last return the columns of documents. Stages set the bytes of an Arrow batch for
the session, unless it names its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import decontaminate, quality, secrets, sentencepiece_fst, simhash
from riskloom.llm.common import small_batches, staged, table


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    small_batches(spark)
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a marker."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of the text, their number, and whether they decode to the same text."""
    small_batches(spark)
    return sentencepiece_fst.encode(docs, cache_size=50_000, most_pairs=150_000)  # an executor keeps what earlier stages took, too


STAGES = [
    ("quality classifier", reject_poor),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding and decoding", encode),
]

#: The trees and the fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
