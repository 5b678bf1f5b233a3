"""Alignment hits: filter, best targets, union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def filtered(hits: DataFrame, identity: float = 0.7, length_difference: float = 0.7, coverage_short: float = 0.0, coverage_long: float = 0.0) -> DataFrame:
    """Hits strictly above all four thresholds."""
    short, long = F.least("qlen", "slen").cast("double"), F.greatest("qlen", "slen").cast("double")
    return hits.filter((F.col("pident") / 100.0 > identity) & (short / long > length_difference) & (F.col("length") / short > coverage_short) & (F.col("length") / long > coverage_long))


def best_targets(hits: DataFrame, k: int = 2000) -> DataFrame:
    """The ``k`` best hits of each query."""
    w = Window.partitionBy("qseqid").orderBy(F.desc("bitscore"), "evalue", "sseqid", "qstart", "sstart")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")


def combined(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
