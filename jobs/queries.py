"""The jobs as queries: each runs twice into one new folder and returns its whole output; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from genoloom import storage
from jobs.collect_families import collect_families
from jobs.group_markers import group_markers


def _folder(spark: SparkSession, name: str) -> str:
    return f"{storage.shared_root(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_collect_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` stand for genes and their sources for samples."""
    at = _folder(spark, "collect_families")
    for _ in range(2):
        out = collect_families(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    return out.drop("bucket")


def job2_group_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for families, suppliers for samples and nations for their groups."""
    at = _folder(spark, "group_markers")
    for _ in range(2):
        out = group_markers(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/supplier.parquet", f"{at}/out")
    return out.withColumn("group", F.col("group").cast("long"))


QUERIES = {"job1_collect_families": job1_collect_families, "job2_group_markers": job2_group_markers}

ORACLE_SQL = {
    "job1_collect_families": """
WITH g AS (SELECT source AS sample_id, doc_id AS gene_id, length(text)::BIGINT AS length,
  regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[ \\t\\n\\r]', '', 'g') AS residues
  FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
f AS (SELECT md5(residues) AS family, arg_min(gene_id, (-length, gene_id)) AS representative, count(DISTINCT sample_id)::BIGINT AS n_isolates,
  count(*)::BIGINT AS n_sequences, min(length) AS min_length, max(length) AS max_length, sum(length)::DOUBLE / count(*) AS mean_length
  FROM g WHERE residues <> '' GROUP BY 1),
n AS (SELECT count(DISTINCT sample_id)::DOUBLE AS n FROM g WHERE residues <> '')
SELECT f.*, CASE WHEN n_isolates / n >= 0.99 THEN 'core' WHEN n_isolates / n >= 0.95 THEN 'soft_core' WHEN n_isolates / n >= 0.15 THEN 'shell' ELSE 'cloud' END AS class FROM f, n
""",
    "job2_group_markers": """
WITH s AS (SELECT DISTINCT s_suppkey AS sample_id, s_nationkey::BIGINT AS "group" FROM supplier WHERE s_suppkey IS NOT NULL AND s_nationkey IS NOT NULL),
z AS (SELECT "group", count(DISTINCT sample_id)::BIGINT AS n_samples FROM s GROUP BY 1),
m AS (SELECT DISTINCT l_partkey AS family, l_suppkey AS sample_id FROM lineitem WHERE l_partkey IS NOT NULL),
t AS (SELECT s."group", family, count(*)::BIGINT AS n_isolates FROM m JOIN s USING (sample_id) GROUP BY 1, 2),
h AS (SELECT t.*, n_samples, n_isolates::DOUBLE / n_samples AS share FROM t JOIN z USING ("group")),
e AS (SELECT family, "group", (sum(n_isolates) OVER (PARTITION BY family) - n_isolates)::DOUBLE / ((SELECT sum(n_samples) FROM z) - n_samples) AS elsewhere FROM h)
SELECT h.family, n_isolates, n_samples, share,
  CASE WHEN share >= 0.99 THEN 'core' WHEN share >= 0.95 THEN 'soft_core' WHEN share >= 0.15 THEN 'shell' ELSE 'cloud' END AS class,
  elsewhere, share >= 0.9 AND elsewhere <= 0.2 AS marker, h."group"
FROM h JOIN e ON h.family = e.family AND h."group" = e."group"
""",
}
