"""Exact dedup, with DataFrame functions only.

Rows are grouped by a 128-bit hash of the normalised text (every ASCII white space character deleted).
Inside the groups of two or more, texts are compared byte by byte; a group in which they differ is split
by the texts themselves. Texts move only for that comparison, and map-side partial aggregates reduce a
group of any size to two texts a task.

Defined results: a null text counts as empty; all empty texts are equal; a null id comes after every
other; rows that tie in everything are told apart by their place in the input, so that exactly one row of
each group stays; an empty table gives an empty result. Other columns are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from genoloom.llm import shared

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def md5_key(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_key=md5_key) -> DataFrame:
    """One row a document: _rid (its number, see ``shared.numbered``), doc_id, keep_id, group_size, kept, text_sha256."""
    docs = shared.numbered(docs)
    norm = normalised(docs[text_col])
    base = docs.select(
        docs[shared.RID].alias("_rid"),
        docs[id_col].alias("_id"),
        F.length(F.coalesce(docs[text_col], F.lit(""))).alias("_len"),
        norm.alias("_norm"),
    )
    slim = shared.written(
        base.select("_rid", "_id", "_len", hash_key(F.col("_norm")).alias("_key"), F.unhex(F.sha2(F.col("_norm"), 256)).alias("_sha")),
        "dedup",
    )
    # written, so that the join reads two plain shuffles and large groups can be split
    again = shared.written(slim.groupBy("_key").count().filter("count > 1").select("_key"), "copies")
    texts = base.select("_rid", "_norm", hash_key(F.col("_norm")).alias("_key"))
    # grouped by an expression, so that the join's partitions needn't keep a key together and may be split
    mixed = texts.join(again, "_key").groupBy(F.reverse("_key").alias("_yek")).agg(F.min("_norm").alias("_lo"), F.max("_norm").alias("_hi")).filter("_lo <> _hi").select(F.reverse("_yek").alias("_key"))
    mixed = shared.written(mixed, "collisions")
    if mixed.isEmpty():
        slim = slim.withColumn("_text", F.lit(""))
    else:
        apart = texts.join(mixed, "_key").select("_rid", F.col("_norm").alias("_text"))
        slim = shared.written(slim.join(apart, "_rid", "left").fillna("", ["_text"]), "dedup")
    best = slim.groupBy("_key", "_text").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("_len")).alias("_less"), F.col("_id").isNull().alias("_none"), "_id", "_rid")).alias("_best"),
    )
    best = best.select("_key", "_text", "group_size", F.col("_best._id").alias("keep_id"), F.col("_best._rid").alias("_keep_rid"))
    best = shared.written(best, "best")
    return slim.join(best, ["_key", "_text"]).select(
        "_rid",
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_rid") == F.col("_keep_rid")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = shared.numbered(docs)
    with shared.scope():
        lost = decisions(rows, id_col, text_col).filter("not kept").select(F.col("_rid").alias(shared.RID))
        lost = shared.kept(shared.written(lost, "lost"))
    return rows.join(lost, shared.RID, "left_anti").drop(shared.RID)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("_rid")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
g AS (SELECT doc_id, n, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size
      FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(n) AS text_sha256 FROM g
"""
