"""From raw documents to packed training sequences, as five stages.

Rejected documents go, one document of each near-duplicate group stays, secrets are covered, sources are mixed to their
target shares, and what is left is packed. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, mixing, packing, quality_rules, secrets
from tidemark.llm._store import Scratch, mark, sweep

#: Near duplicates here: sets of five-word shingles with a similarity of 0.8 or more.
NEAR = jaccard.Join(n=5, num=80, den=100)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, as they are. A null or empty text has too few words and goes; repeated rows
    all stay or all go."""
    return quality_rules.kept(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row of the smallest doc_id, one of repeated rows; null ids come last. Documents
    without words have no duplicates but rows equal to them."""
    return jaccard.representatives(docs, NEAR)


def cover_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced by the names of their kinds; a null text stays null."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows as often as it takes them, at most three times, and one cut short in each source. Documents without
    words aren't taken; null is a source of its own."""
    return mixing.remixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, with their ids and their places in sequences. A null text is only its end token."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", reject_low_quality),
    ("n-gram jaccard join", keep_one_of_near_duplicates),
    ("secret scans", cover_secrets),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]
#: Tokenising isn't to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read again as the next one's input. What a stage
    wrote on its way is deleted when its rows are there."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        begun = mark()
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        sweep(spark, begun)
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
