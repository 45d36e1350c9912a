"""A corpus from raw documents: language ID, fuzzy line dedup, near dedup, mixing to weights, packing.

Each stage works on all that its predecessor kept and, but for the last, returns the columns of documents. Its result is
written as Parquet into the shared folder and read again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import language, lines, mixing, near, packing
from tracewell.llm.common import written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence can't tell go."""
    return language.kept_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines one occurrence stays."""
    return lines.without_fuzzy_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gives its budget of words; sources above their size repeat."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", keep_known_languages),
    ("lines", drop_repeated_lines),
    ("near", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, SimHash, MinHash and tokenizers have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
