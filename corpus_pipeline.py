"""A corpus pipeline over documents: language ID, line dedup, SimHash near-dedup, benchmark decontamination, mixing.

Each stage is written as Parquet in the shared folder and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plansmith.llm import decontamination, langid, line_dedup, mixing, simhash
from plansmith.llm.common import Scratch, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_recognised(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix)]

#: Language identification and SimHash aren't expressible in SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, was = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(was)
        was = docs
    return docs
