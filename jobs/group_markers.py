"""How common each family is in each group of samples, and the families that mark a group.

Users of a collection compare groups of genomes: hosts, countries, lineages. This job reads a table of members (a row a gene,
with its family and sample) and a table of samples with their groups. It writes ``shares``, partitioned by group: for each family that the group has,
the samples of the group that have it, their share, the class within the group, the share of all other samples
that have it, and whether the family marks the group; and ``groups``, a row a group, with its samples and the families of each class.

A run replaces the partitions of the groups that the samples have, so that it runs again with the same result, and groups that another
run wrote stay. Members whose sample isn't in the table, or has no group, take no part; their number is logged.

    python -m jobs.group_markers MEMBERS SAMPLES OUTPUT [--config FILE]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from genoloom.operators import report
from jobs.common import command, log, replace_partitions, settings


def shares(members: DataFrame, samples: DataFrame, c: dict) -> DataFrame:
    """A row for each family and group that has it; samples (sample_id, group) and members (family, sample_id). A sample has one group."""
    size = samples.groupBy("group").agg(F.countDistinct("sample_id").alias("n_samples"))
    # a row a family and sample before the join, as a family has many genes in a sample
    cell = members.distinct().join(samples.distinct(), "sample_id")
    t = cell.groupBy("group", "family").agg(F.count("*").alias("n_isolates")).join(size, "group")
    t = t.withColumn("share", F.col("n_isolates") / F.col("n_samples"))
    t = report.classes(t, F.col("n_samples"), c["core"], c["soft"], c["shell"])
    own = Window.partitionBy("family")  # a row a group
    t = t.withColumn("others", F.sum("n_isolates").over(own) - F.col("n_isolates"))
    rest = F.lit(samples.select("sample_id").distinct().count()) - F.col("n_samples")
    t = t.withColumn("elsewhere", F.when(rest > 0, F.col("others") / rest).otherwise(0.0))
    marks = (F.col("share") >= c["inside"]) & (F.col("elsewhere") <= c["outside"])
    return t.select("family", "n_isolates", "n_samples", "share", "class", "elsewhere", marks.alias("marker"), "group")


def group_markers(spark: SparkSession, members: str, samples: str, out: str, config: dict | None = None) -> DataFrame:
    """Write the shares of the groups and return all of them that ``out`` has."""
    c = settings("group_markers") | (config or {})
    seen, named = Observation(), Observation()
    m = spark.read.parquet(members).select(F.col(c["family"]).alias("family"), F.col(c["sample"]).alias("sample_id")).observe(seen, F.count("*").alias("rows"))
    s = spark.read.parquet(samples).select(F.col(c["sample_id"]).alias("sample_id"), F.col(c["group"]).alias("group")).filter("sample_id IS NOT NULL AND group IS NOT NULL")
    s = s.observe(named, F.count("*").alias("rows"))
    replace_partitions(shares(m.filter("family IS NOT NULL"), s, c), f"{out}/shares", "group")
    log.info("read %d genes and %d samples with a group", seen.get["rows"], named.get["rows"])
    done = spark.read.parquet(f"{out}/shares")
    lost = spark.read.parquet(members).select(F.col(c["sample"]).alias("sample_id")).join(s.select("sample_id").distinct(), "sample_id", "left_anti").count()
    if lost:
        log.info("%d genes are of samples without a group", lost)
    each = done.groupBy("group").agg(F.first("n_samples").alias("n_samples"), *(F.count_if(F.col("class") == k).alias(k) for k in report.LABELS[:-1]), F.count_if("marker").alias("markers"))
    each.coalesce(1).write.mode("overwrite").parquet(f"{out}/groups")
    for r in spark.read.parquet(f"{out}/groups").orderBy("group").limit(100).collect():
        log.info("wrote group %s: %d samples, %d core families, %d markers", r["group"], r["n_samples"], r["core"], r["markers"])
    return done


if __name__ == "__main__":
    command("group_markers", __doc__.partition("\n")[0], {"members": "table of genes with family and sample", "samples": "table of samples with group", "out": "folder of the output"}, group_markers)
