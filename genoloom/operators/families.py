"""Families of genes: from clusters of representatives to all members, and comparison of two sets of families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def numbered(groups: DataFrame, order: list, key: str = "key") -> DataFrame:
    """(cluster_idx, key): keys numbered by ``order``. The keys are sorted in ranges and counted by range,
    so that no task sees them all."""
    spark = groups.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = groups.repartitionByRange(parts, *order, key).sortWithinPartitions(*order, key)
    from genoloom.storage import checkpoint

    t = checkpoint(t.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = sorted(t.groupBy("_p").count().collect())  # a row a partition
    starts, n = [], 0
    for p, size in sizes:
        starts.append((p, n))
        n += size
    start = spark.createDataFrame(starts, "_p int, _start long")
    return t.join(F.broadcast(start), "_p").select((F.col("_start") + F.col("_i")).alias("cluster_idx"), key)


def reinflated(mcl: DataFrame, dedup: DataFrame) -> DataFrame:
    """membership of the clusters (mcl_ord, gene_id, ord) with each representative's members after it, then of the
    representatives of ``dedup`` (rep_id, member_id, member_ord; member_id null for singletons) that no cluster has."""
    return reinflated_add(mcl, dedup, None, None)


def reinflated_add(mcl: DataFrame, old: DataFrame, matched: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """The same with up to three sources of members: saved clusters, genes matched to their representatives, and new
    clusters. Representatives of either kind that no cluster has become families of their own."""
    sources = [(0, old), (1, matched), (2, new)]
    members = None
    for rank, s in sources:
        if s is not None:
            t = s.filter("member_id is not null").select("rep_id", "member_id", F.lit(rank).alias("rank"), F.col("member_ord").cast("long").alias("member_ord"))
            members = t if members is None else members.unionByName(t)
    reps = None
    for rank, s in ((0, old), (2, new)):
        if s is not None:
            t = s.select("rep_id").distinct().withColumn("rank", F.lit(rank))
            reps = t if reps is None else reps.unionByName(t)
    alone = reps.groupBy("rep_id").agg(F.min("rank").alias("rank")).join(mcl.select(F.col("gene_id").alias("rep_id")), "rep_id", "left_anti")
    heads = mcl.select(F.lit(0).alias("part"), F.col("mcl_ord").cast("long").alias("a"), F.lit("").alias("b"), F.col("ord").cast("long").alias("o"), "gene_id")
    heads = heads.unionByName(alone.select((F.col("rank") + 1).alias("part"), F.lit(0).cast("long").alias("a"), F.col("rep_id").alias("b"), F.lit(0).cast("long").alias("o"), F.col("rep_id").alias("gene_id")))
    keys = heads.select(F.struct("part", "a", "b").alias("key")).distinct()
    index = numbered(keys, ["key"])
    heads = heads.withColumn("key", F.struct("part", "a", "b")).join(index, "key").select("cluster_idx", "o", "gene_id")
    own = heads.select("cluster_idx", "o", F.lit(-1).alias("rank"), F.lit(0).cast("long").alias("member_ord"), "gene_id")
    more = heads.join(members, heads["gene_id"] == members["rep_id"]).select("cluster_idx", "o", "rank", "member_ord", F.col("member_id").alias("gene_id")) if members is not None else None
    every = own.unionByName(more) if more is not None else own
    w = Window.partitionBy("cluster_idx").orderBy("o", "rank", "member_ord", "gene_id")
    return every.select("cluster_idx", (F.row_number().over(w) - 1).cast("long").alias("member_ord"), "gene_id")


def merged_clusters(old: DataFrame, matched: DataFrame, new: DataFrame) -> DataFrame:
    """Saved clusters with the genes matched to them, and the new ones."""
    base = old.groupBy("rep_id").agg(F.max("member_ord").alias("n"))
    more = matched.join(base, "rep_id", "left").select("rep_id", "member_id", (F.coalesce("n", F.lit(-1)) + 1 + F.col("member_ord")).alias("member_ord"))
    grown = more.select("rep_id").distinct()
    kept = old.filter("member_id is not null").unionByName(old.filter("member_id is null").join(grown, "rep_id", "left_anti"))
    return kept.unionByName(more).unionByName(new)


def equal_families(a: DataFrame, b: DataFrame) -> DataFrame:
    """same, diff, total of the families of ``a`` that are, as sets, families of ``b`` (columns cluster, gene_id)."""
    def sets(t):
        return t.groupBy("cluster").agg(F.array_sort(F.collect_set("gene_id")).alias("genes"))

    found = sets(a).join(sets(b).select("genes").distinct().withColumn("hit", F.lit(1)), "genes", "left")
    return found.agg(F.count("hit").alias("same"), F.count_if(F.col("hit").isNull()).alias("diff"), F.count("*").alias("total"))


def kept_families(old: DataFrame, new: DataFrame) -> DataFrame:
    """cluster, size, same: whether an old family is a subset of one new family."""
    old, new = old.distinct(), new.distinct()
    size = old.groupBy("cluster").agg(F.count("*").alias("size"))
    both = old.join(new.select(F.col("cluster").alias("other"), "gene_id"), "gene_id").groupBy("cluster", "other").agg(F.count("*").alias("n"))
    best = both.groupBy("cluster").agg(F.max("n").alias("n"))
    return size.join(best, "cluster", "left").select("cluster", "size", (F.coalesce("n", F.lit(0)) == F.col("size")).alias("same"))
