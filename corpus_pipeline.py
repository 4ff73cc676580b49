"""A corpus from raw documents: quality, exact and near duplicates, source mix, token ids.

Every stage works on all that its predecessor kept, and its decisions take effect. Repeated doc_ids, null columns, very
long texts and empty tables are handled as the operators say: texts are scored, compared and encoded whole. Columns of
the documents other than those named pass through the stages that keep columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm import exact_dedup, mixing, ngram_join, pieces, quality
from planloom.llm.base import table, written
from planloom.session import ship

ORACLE_SQL = None  # compression, MinHash banding and token ids have no SQL


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of at least the classifier's accepted score go on."""
    ship(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= quality.ACCEPTED_FROM)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    ship(spark)
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram join connects."""
    ship(spark)
    return ngram_join.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    ship(spark)
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, round_trip."""
    ship(spark)
    return pieces.encode(docs).select("doc_id", "ids", "round_trip")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("source mixing", mixed_sources),
    ("SentencePiece encoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
