"""From `documents` to a mixed training table: each stage calls one operator on all rows that the one before it kept.

quality rejects documents, dedup leaves one of each near-duplicate class, decontaminate drops documents that hold a
benchmark item, secrets masks credentials in the texts, mix leaves the documents that the target weights give at least one
copy, with the number of copies that each stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, mixing, quality, secrets, similar
from lodestrata.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Shares of tokens after the last stage. The quality stage leaves hardly any junk, so a larger share of it would have to come
#: from a few documents repeated a thousand times; toxic text gets about two thirds of the weight that it has by itself.
TARGETS = {"clean": 0.92, "toxic": 0.08, "junk": 0.0001}


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs).select(*COLUMNS)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(docs, table(spark, sf_dir, "labels"), targets=TARGETS)
    return mixed.select(*COLUMNS, "tokens", "p_clean", "p_toxic", "p_junk", "rate", "copies")


STAGES = [
    ("quality", stage_quality),
    ("dedup", stage_dedup),
    ("decontaminate", stage_decontaminate),
    ("secrets", stage_secrets),
    ("mix", stage_mix),
]

#: SQL cannot express the fitted models of the stages; each is tested on its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
