"""Corpus pipeline: toxicity, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of ``documents``; their rows are written as Parquet and read again by the next.

* toxicity: a model learnt from ``labels`` (fold 0 held out); documents that score 0.5 or more go.
* language: a model learnt from the rows' own ``lang`` (fold 0 held out); documents without a letter, and those whose
  best language has a score below 0.4, go.
* near_duplicates: one document of each component stays, the one with the smallest id.
* secrets: every span found is replaced by ``[secret]``; ``n_chars`` follows the text. No document goes.
* packing: the pieces of all documents, with sequence and offset.

Null texts are empty: not toxic, but without a letter, so they go at the second stage. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadsift.llm import dedup, language, packing, secrets, toxicity
from roadsift.llm.common import documents, fold, materialize


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id") != 0)
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.recognised(docs, language.fit(docs.where((fold("doc_id") != 0) & F.col("lang").isNotNull())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kind = dict(docs.dtypes)["n_chars"]
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(kind))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Models, components and a linear program can't be expressed in SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
