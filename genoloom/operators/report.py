"""Presence and absence of families in samples, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CORE, SOFT, SHELL = 0.99, 0.95, 0.15
LABELS = ("core", "soft_core", "shell", "cloud", "total")


def presence(members: DataFrame) -> DataFrame:
    """family, sample_id, n, gene_ids of (family, sample_id, gene_id, ord)."""
    return members.groupBy("family", "sample_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "gene_id"))), lambda x: x["gene_id"]).alias("gene_ids"))


def members_of(families: DataFrame) -> DataFrame:
    return families.select(F.col("name").alias("family"), F.posexplode("gene_ids").alias("ord", "gene_id")).withColumn("sample_id", F.split("gene_id", "-", 2)[0])


def family_stats(members: DataFrame) -> DataFrame:
    """n_isolates, n_sequences and their ratio for each family."""
    t = members.groupBy("family", "sample_id").agg(F.count("*").alias("n"))
    return t.groupBy("family").agg(F.count("*").alias("n_isolates"), F.sum("n").alias("n_sequences")).withColumn("avg_per_isolate", F.col("n_sequences") / F.col("n_isolates"))


def pivoted(long: DataFrame, samples: list[str], value: str = "n", empty=0) -> DataFrame:
    """A column a sample; at export only, as a long table serves everything else."""
    return long.groupBy("family").pivot("sample_id", samples).agg(F.first(value)).na.fill(empty)


def classes(present: DataFrame, n_samples: int | Column, core: float = CORE, soft: float = SOFT, shell: float = SHELL) -> DataFrame:
    """Adds class to (family, n_isolates); the samples are a number, or a column where rows are of several groups."""
    if not isinstance(n_samples, Column):
        if n_samples <= 0:
            raise ValueError("no samples")
        n_samples = F.lit(float(n_samples))
    share = F.col("n_isolates") / n_samples
    return present.withColumn("class", F.when(share >= core, "core").when(share >= soft, "soft_core").when(share >= shell, "shell").otherwise("cloud"))


def summary(present: DataFrame, n_samples: int, core: float = CORE, soft: float = SOFT, shell: float = SHELL) -> DataFrame:
    """class, n: the four classes and the total, zeros too; one partial aggregate, no join."""
    t = classes(present, n_samples, core, soft, shell).agg(*[F.count_if(F.col("class") == c).alias(c) for c in LABELS[:4]], F.count("*").alias("total"))
    return t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in LABELS])).alias("x")).select("x.class", "x.n")


def single_copy_core(members: DataFrame, n_samples: int) -> DataFrame:
    """Families with one gene of every sample."""
    t = members.groupBy("family", "sample_id").agg(F.count("*").alias("n")).groupBy("family").agg(F.count("*").alias("s"), F.max("n").alias("m"))
    return t.filter((F.col("s") == n_samples) & (F.col("m") == 1)).select("family")


def large_families(families: DataFrame, n_samples: int, ratio: float = 0.0) -> DataFrame:
    """Families of at least max(2, share of the samples) genes."""
    return families.filter(F.size("gene_ids") >= max(2, int(n_samples * ratio)))


def representatives(clusters: DataFrame, annotation: DataFrame) -> DataFrame:
    """rep: the longest gene of each raw cluster, the first among equals."""
    return clusters.join(annotation.select("gene_id", "ann_ord", "length"), "gene_id").groupBy("cluster_idx").agg(F.max_by("gene_id", F.struct("length", -F.col("ann_ord"))).alias("rep"))
