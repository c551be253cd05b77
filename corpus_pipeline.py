"""A training corpus from raw documents: quality rules, line dedup, near-dedup, source mixing, packing.

Each stage gets what its predecessor kept, written as Parquet and read again, and returns the columns of ``documents``;
the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.llm import line_templates, mixture, packing, quality_rules, simhash
from plansift.llm.common import drop_saved, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring template lines go; ``n_chars`` follows the text."""
    cut = line_templates.drop_recurring(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; what is taken twice is there twice."""
    return mixture.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_copies), ("mixing", mix), ("packing", pack)]

#: Expectation-maximisation, template trees, components and online packing are no SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        before = docs
        docs = settled(lambda: stage(spark, before, sf_dir), f"stage{n}")  # noqa: B023
        drop_saved(before)
    return docs
