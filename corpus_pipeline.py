"""The corpus pipeline over ``documents``: toxic documents, exact copies, near copies and benchmark passages go, and
the rest is mixed to its sources' target weights.

Each stage takes the table that the one before wrote and decides about all of it. All but the last return the
columns of ``documents``; the last adds how often the mix has a document (``copies``), and its figures.

Defined results of all stages: null text counts as empty; a null doc_id is a document like any other, last in ties; repeated
rows are separate rows until a dedup stage leaves one; other columns, whatever their names, are kept; an empty
table stays empty. Empty texts are one group of copies; a text without words has fingerprint zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genoloom.llm import decontaminate, exact_dedup, mixing, shared, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the model is fitted on labels of those that are here."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts, the longest original."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the least doc_id."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, and how often it has them."""
    return mixing.mixture(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, shared.written(stage(spark, docs, sf_dir), name)
        if k:
            shared.drop(last)
    return docs


ORACLE_SQL = None
