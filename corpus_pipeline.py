"""The corpus pipeline over documents: quality rules, near-duplicates, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. The first three return the columns of documents; the last adds the
pieces. Counts, statistics and candidates of a stage cover all of its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duelframe.llm import mixing, near_dedup, pieces, quality
from duelframe.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on shingles of five words, the one with the least
    doc_id stays."""
    return near_dedup.drop_near(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic and poor documents are thinned out, or repeated, to their targets as expected totals; clean
    ones keep a rate of about 1, which is rounded to the nearest whole number, and so stay."""
    return mixing.mixed(docs, mixing.label_domains(table(spark, sf_dir, "labels")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with piece_ids and the decoded text, in one pass."""
    return pieces.encode_decoded(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("pieces", encode_pieces),
]

#: SQL can't express the last stage's segmentation; tests compare it with the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
