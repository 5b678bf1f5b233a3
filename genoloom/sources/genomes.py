"""Samples, and the features and sequences of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from genoloom.functions.sequences import no_dash
from genoloom.sources.genome_files import register

EXTENSIONS = r"\.(gff3?|GFF3?)(\.gz)?$"


def samples_from_table(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Samples of a file of tab-separated id, GFF file and assembly (may be empty); the first of an id wins."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).filter("line <> ''")
    cell = lambda i: F.try_element_at(F.split("line", "\t", -1), F.lit(i))
    t = lines.select("line_no", no_dash(cell(1)).alias("sample_id"), cell(2).alias("gff_file"), F.nullif(cell(3), F.lit("")).alias("assembly"))
    bad = t.filter(F.col("gff_file").isNull() | ~F.col("gff_file").rlike(r"\.gff(\.gz)?$")).limit(1).collect()
    if bad:
        raise ValueError(f"line {bad[0].line_no + 1}: expected id, a .gff or .gff.gz file, assembly")
    return numbered_samples(t, known)


def samples_from_paths(spark: SparkSession, paths: list[str], known: DataFrame | None = None) -> DataFrame:
    """Samples named after their GFF files."""
    t = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "line_no int, gff_file string")
    base = F.regexp_extract("gff_file", "[^/]*$", 0)
    bad = t.filter(~base.rlike(EXTENSIONS)).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].gff_file}: not a GFF file's name")
    t = t.select("line_no", no_dash(F.regexp_replace(base, EXTENSIONS, "")).alias("sample_id"), "gff_file", F.lit(None).cast("string").alias("assembly"))
    return numbered_samples(t, known)


def numbered_samples(t: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """First row of each sample id, without those of ``known``, numbered on from it."""
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("sample_id").orderBy("line_no"))).filter("n = 1").drop("n")
    start = 0
    if known is not None:
        t = t.join(known.select("sample_id"), "sample_id", "left_anti")
        last = known.agg(F.max("sample_ord")).first()[0]
        start = 0 if last is None else last + 1
    # the list of samples is the command's input, a row a genome
    return t.select((F.row_number().over(Window.orderBy("line_no")) - 1 + start).cast("long").alias("sample_ord"), "sample_id", "gff_file", "assembly")


def require(samples: DataFrame, least: int) -> None:
    if samples.limit(least).count() < least:
        raise ValueError(f"at least {least} sample(s) needed")


def _paths(samples: DataFrame, column: str) -> list[str]:
    """The command's list of files."""
    return [r[0] for r in samples.select(column).filter(F.col(column).isNotNull()).distinct().collect()]


def _read(samples: DataFrame, kind: str, column: str) -> DataFrame:
    spark = samples.sparkSession
    register(spark)
    t = spark.read.format(kind).option("paths", "\n".join(_paths(samples, column))).load()
    return t.join(samples.select("sample_id", F.col(column).alias("path")), "path").drop("path")


def gff_features(samples: DataFrame) -> DataFrame:
    """The features of the samples' files: sample_id, line_no (the place in the file) and the nine cells of GFF."""
    return _read(samples, "gff", "gff_file")


def contigs(samples: DataFrame) -> DataFrame:
    """sample_id, contig_id, seq: the assembly's records, or those after ``##FASTA`` where it has none; of equal ids the last."""
    inside = _read(samples, "fasta", "gff_file").withColumn("rank", F.lit(1))
    both = _read(samples, "fasta", "assembly").withColumn("rank", F.lit(0)).unionByName(inside)
    last = both.groupBy("sample_id", "rank", no_dash(F.col("name")).alias("contig_id")).agg(F.max_by("seq", "rec_no").alias("seq"))
    best = last.groupBy("sample_id").agg(F.min("rank").alias("rank"))
    return last.join(best, ["sample_id", "rank"], "left_semi").select("sample_id", "contig_id", "seq")
