"""The training-data pipeline: STAGES in order, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import language_id, line_dedup, near_dedup, packing, source_mixing
from fathom.llm._common import drop_stored, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learned from docs themselves."""
    return language_id.filtered(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words or more; those of which nothing is left go. n_chars follows the text."""
    return line_dedup.filtered(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words."""
    return near_dedup.filtered(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences of 1024 tokens."""
    return packing.packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Learned models, tilts and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in sf_dir."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    read = None
    for _, stage in first:
        docs = stored(stage(spark, docs, sf_dir))
        if read is not None:
            drop_stored(read)
        read = docs
    return last(spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
