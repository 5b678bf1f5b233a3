"""Names, products and representatives of families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from genoloom.functions.sequences import suffixed


def described(membership: DataFrame, annotation: DataFrame) -> DataFrame:
    """Figures of each family; ties go to the gene that comes first in the annotation."""
    t = membership.join(annotation.select("gene_id", "ann_ord", "length", "gene_name", "gene_product"), "gene_id", "left")
    t = t.withColumns({"gene_name": F.coalesce("gene_name", F.lit("")), "gene_product": F.coalesce("gene_product", F.lit(""))})
    names = t.filter("gene_name <> ''").groupBy("cluster_idx", "gene_name").agg(F.count("*").alias("n"), F.min("ann_ord").alias("first"))
    names = names.groupBy("cluster_idx").agg(F.max_by("gene_name", F.struct("n", -F.col("first"))).alias("base"))
    own = t.groupBy("cluster_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("member_ord", "gene_id"))), lambda x: x["gene_id"]).alias("gene_ids"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("gene_product", F.lit("")))), ", ").alias("product"),
        F.max_by("gene_id", F.struct("length", -F.col("ann_ord"))).alias("representative"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.avg("length").alias("mean_length"),
        F.count("*").alias("size"),
    )
    base = F.coalesce("base", F.concat(F.lit("groups_"), F.col("cluster_idx")))
    return own.join(names, "cluster_idx", "left").withColumns({"base": base, "product": F.coalesce(F.nullif("product", F.lit("")), F.lit("unknown"))})


def named(families: DataFrame) -> DataFrame:
    """Adds name to (cluster_idx, base): the base, or for one that is taken the base with a number that counts all such
    families in order. A base that another's numbered name equals can't be told apart, and is refused."""
    from genoloom.operators.families import numbered

    later = families.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("cluster_idx"))).filter("k > 1")
    keys = later.select(F.col("cluster_idx").alias("key"), "base")
    numbers = numbered(keys.select("key"), ["key"]).select(F.col("key").alias("cluster_idx"), (F.col("cluster_idx") + 1).alias("suffix"))
    again = later.select("cluster_idx", "base").join(numbers, "cluster_idx").select("cluster_idx", suffixed(F.col("base"), F.col("suffix")).alias("name"))
    if not again.join(families.select(F.col("base").alias("name")), "name", "left_semi").isEmpty():
        raise ValueError("a family's own name looks like a numbered name of another")
    return families.join(again, "cluster_idx", "left").withColumn("name", F.coalesce("name", "base"))


def annotated(membership: DataFrame, annotation: DataFrame) -> DataFrame:
    return named(described(membership, annotation)).select(F.col("cluster_idx").alias("family_ord"), "name", "gene_ids", "product", "representative", "min_length", "max_length", "mean_length", "size")
