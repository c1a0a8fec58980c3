"""Documents to a training corpus: quality, near-duplicates, leaks, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last adds each document's rate.

Every stage works row by row, not by doc_id: rows with a null or repeated doc_id are documents like others. A null text
is judged as an empty one and stays null. An empty table gives an empty table with the same columns. Columns beside
those of documents pass through, whatever their names (but `rate`, which the last stage sets anew).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontam, mixing, neardup, pii, quality
from gleaner.llm._io import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; without labelled texts, and at even odds, a document stays."""
    return quality.good_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 of five-word shingles) stays: the least doc_id, nulls last.

    Equal rows are near-duplicates; rows of one doc_id with different texts are not. Texts without words all stay.
    """
    return neardup.without_near_duplicates(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold 13 benchmark words in a row, or of which a twentieth are words of whole shorter items.

    Those that stay lose the words of shorter items. Null texts hold nothing and stay.
    """
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"), whole=True)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, in each row by itself; no row goes, and a null text stays null."""
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates that bring the corpus to the target weights; documents rated zero go.

    Equal rows get equal rates; texts without words are rated by their posteriors. Without labelled texts all rates are equal.
    """
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Trained models and sketches are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
