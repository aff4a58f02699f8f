"""A corpus pipeline of five stages: language, boilerplate lines, near copies, benchmark leaks, packing.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents; the
last returns packed pieces. run() writes every stage's result as Parquet in the shared folder and reads
it again as the next stage's documents.

SQL cannot express the first stage (a trained network) or the last (packing by a tokenizer), so
ORACLE_SQL is None; the tests hold run() against a brute-force version.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from kinlattice.llm import decontam, language_id, line_dedup, ngram_join, packing
from kinlattice.llm.common import rested, staged, table

ORACLE_SQL = None


def apart(stage):
    """A stage that begins when executors have given back what earlier work left."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rested(spark)
        return stage(spark, docs, sf_dir)

    return run


@apart
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without letters go, and those whose language the network can't tell."""
    return language_id.accepted(docs, language_id.fit(docs.where(~language_id.held_out())))


@apart
def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share go; every document stays, and whole where it has no other line: the next stage judges copies."""
    return line_dedup.dedup(docs, spare_copies=True)


@apart
def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.one_of_each(docs)


@apart
def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


@apart
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, placed in sequences."""
    return packing.packed(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", own_lines),
    ("ngram_join", one_of_copies),
    ("decontam", unseen),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
