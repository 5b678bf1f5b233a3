"""Readers of tables that other tools, or earlier runs, wrote as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from genoloom.storage import checkpoint


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).filter("line <> ''")


def annotation_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A gene annotation file; all columns are text or counts as named, never inferred."""
    schema = "gene_id string, sample_id string, seq_id string, length int, gene_name string, gene_product string, gene_index int, strand string"
    t = spark.read.csv(path, header=True, schema=schema).fillna("")
    return t.select(*columns) if columns else t


def annotation_tsv(spark: SparkSession, path: str) -> DataFrame:
    schema = "gene_id string, sample_id string, seq_id string, length int, gene_name string, gene_product string, gene_index int, strand string"
    return spark.read.csv(path, sep="\t", schema=schema).fillna("")


def positions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ragged lines ``sample,contig,gene,gene,...`` as long rows."""
    c = F.split("line", ",")
    t = _lines(spark, path).select(c[0].alias("sample_id"), c[1].alias("seq_id"), F.posexplode(F.slice(c, 3, 1 << 30)).alias("pos", "gene_id"))
    return t.filter("gene_id <> ''")


def clusters_clstr(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Foreign cluster files as (rep_id, member_id, member_ord); ``ids`` (aa_id, gene_id) names numbered members.

    A file is cut at its headings, and a cluster's text at its lines; a member is named between ``, >`` and the last ``... ``, after which a
    representative has a star.
    """
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.concat(F.lit("\n"), "value").alias("text"))
    blocks = texts.select("file", F.posexplode(F.slice(F.split("text", "\n>"), 2, 1 << 30)).alias("cluster", "block"))
    t = blocks.select("file", "cluster", F.posexplode(F.split("block", "\r?\n")).alias("line_no", "line")).filter("line_no > 0 AND contains(line, ', >')")
    rest = F.substr(F.col("line"), F.locate(", >", "line") + 3)
    t = t.withColumn("rest", rest).withColumn("how", F.substring_index("rest", "... ", -1))
    t = t.select("file", "cluster", "line_no", F.expr("left(rest, length(rest) - length(how) - 4)").alias("gene_id"), "how").filter("gene_id <> ''")
    if ids is not None:
        t = t.withColumnRenamed("gene_id", "aa_id").join(ids.withColumn("aa_id", F.col("aa_id").cast("string")), "aa_id")
    reps = t.filter("how = '*'").select("file", "cluster", F.col("gene_id").alias("rep_id"))
    members = t.filter("how <> '*'").select("file", "cluster", "line_no", F.col("gene_id").alias("member_id"))
    return reps.join(members, ["file", "cluster"], "left").select("rep_id", "member_id", F.col("line_no").alias("member_ord"))


def clusters_lines(spark: SparkSession, path: str) -> DataFrame:
    """One cluster a line, ids separated by tabs: (mcl_ord, gene_id, ord)."""
    return _lines(spark, path).select(F.col("line_no").cast("long").alias("mcl_ord"), F.posexplode(F.split("line", "\t")).alias("ord", "gene_id")).select("mcl_ord", "gene_id", "ord")


def matrix_csv(spark: SparkSession, path: str, first: int = 8) -> DataFrame:
    """(cluster, cluster_no, sample_id, gene_id) of a presence/absence matrix whose sample cells begin at column ``first`` (from 0); clusters are
    numbered from 1 in the order of lines."""
    from genoloom.operators.families import numbered

    t = spark.read.csv(path, header=True, quote='"', escape='"').withColumn("_place", F.monotonically_increasing_id())
    names = t.columns[:-1]
    cells = F.array(*[F.struct(F.lit(c).alias("sample_id"), F.coalesce(F.col(f"`{c}`"), F.lit("")).alias("cell")) for c in names[first:]])
    t = checkpoint(t.select("_place", F.col(f"`{names[0]}`").alias("cluster"), cells.alias("cells")))
    order = numbered(t.select(F.col("_place").alias("key")), ["key"]).select((F.col("cluster_idx") + 1).alias("cluster_no"), F.col("key").alias("_place"))
    t = t.join(order, "_place").select("cluster", "cluster_no", F.explode("cells").alias("x"))
    return t.select("cluster", "cluster_no", "x.sample_id", F.explode(F.split("x.cell", "\t")).alias("gene_id")).filter("gene_id <> ''")


def catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.csv(path, header=True)
    return t.withColumn("Size(Mb)", F.col("`Size(Mb)`").try_cast("double"))
