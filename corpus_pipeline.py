"""The training-corpus pipeline: toxicity, quality rules, near-duplicates, personal data, packing.

Rules for odd input, of all stages: a null text is empty, has too few words and goes in the quality stage; very long texts are read whole; rows that
share an id stand apart by their text, repeated rows are one group of near-duplicates, ties go to the least id and then the least digest; an empty table
gives an empty result; other columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidara.llm import near_dup, packing, pii, quality, toxicity
from evidara.llm.common import forget, materialise, table
from evidara.llm.queries import WORD_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learnt verdict go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, similarity of 0.8 or more)."""
    return near_dup.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of every piece in training sequences."""
    return packing.pack(docs, WORD_BPE)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("quality", keep_good), ("near-duplicates", keep_one), ("personal-data", redact), ("packing", pack)]

#: Learnt models cannot be said in SQL; tests hold each stage against its operator and a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
