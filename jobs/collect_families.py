"""Families of identical sequences, kept up to date as new genes arrive.

Users of a pan-genome collection add samples again and again, and want the families, where each is present and how common it is, without
doing the old samples anew. This job is a file stream over a table of sequences that grows by files. A run takes the files that its
checkpoint doesn't know, in micro-batches, then ends. Sequences that are equal without white space and case (of ASCII) are a
family, named by their MD5. For each batch:

1. ``members/epoch=K`` gets a row a gene;
2. ``counts/bucket=B/epoch=K`` gets the batch's genes of each family in each sample, summed up;
3. ``families/bucket=B`` is made anew of ``counts``, in the buckets that the batch has; no text of old genes is read.

All three replace whole partitions, which are the batch's own or follow from ``counts``, so that a batch that failed half way and runs again gives the same
result. At the end ``summary`` is made of the families. Output and checkpoint belong together: neither is of use with another.

A gene without a sequence or a sample is in no family; their number is logged. The same gene in two files counts twice.

    python -m jobs.collect_families INPUT OUTPUT CHECKPOINT [--config FILE]
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from genoloom.operators import report
from jobs.common import command, log, replace_partitions, settings

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Of genes of one family, the longest stands for it; of equals the least id.
_LONGEST = "struct(-length AS shorter, gene_id)"


def genes(rows: DataFrame, c: dict) -> DataFrame:
    """sample_id, gene_id, family, length and bucket of the rows that have a sample and a sequence."""
    t = rows.select(F.col(c["sample"]).cast("string").alias("sample_id"), F.col(c["gene"]).alias("gene_id"), F.col(c["sequence"]).alias("sequence"))
    residues = F.regexp_replace(F.translate("sequence", _LOWER, _UPPER), "[ \\t\\n\\r]", "")
    t = t.select("sample_id", "gene_id", residues.alias("residues"), F.length("sequence").cast("long").alias("length")).filter("sample_id IS NOT NULL AND residues <> ''")
    return t.select("sample_id", "gene_id", F.md5("residues").alias("family"), "length").withColumn("bucket", F.pmod(F.xxhash64("family"), F.lit(c["buckets"])).cast("int"))


def counted(members: DataFrame, *more: str) -> DataFrame:
    """A row for each family and sample: its genes, their lengths and the longest of them."""
    return members.groupBy("bucket", "family", "sample_id", *more).agg(
        F.count("*").alias("n"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.sum("length").alias("residues"), F.min(F.expr(_LONGEST)).alias("first")
    )


def families(counts: DataFrame) -> DataFrame:
    """A row a family, of the counts of all batches."""
    cell = counts.groupBy("bucket", "family", "sample_id").agg(*(f(k).alias(k) for f, k in ((F.sum, "n"), (F.min, "shortest"), (F.max, "longest"), (F.sum, "residues"), (F.min, "first"))))
    t = cell.groupBy("bucket", "family").agg(
        F.count("*").alias("n_isolates"), F.sum("n").alias("n_sequences"), F.min("shortest").alias("min_length"), F.max("longest").alias("max_length"), F.sum("residues").alias("residues"), F.min("first").alias("first")
    )
    return t.select("family", F.col("first.gene_id").alias("representative"), "n_isolates", "n_sequences", "min_length", "max_length", (F.col("residues") / F.col("n_sequences")).alias("mean_length"), "bucket")


def take(spark: SparkSession, out: str, c: dict):
    """The function of a micro-batch."""

    def run(batch: DataFrame, epoch: int) -> None:
        seen = Observation()
        rows = batch.observe(seen, F.count("*").alias("rows"))
        own = genes(rows, c).withColumn("epoch", F.lit(epoch).cast("long"))
        own = own.select("family", "sample_id", "gene_id", "length", "bucket", "epoch")
        replace_partitions(own, f"{out}/members", "epoch")
        members = spark.read.schema(own.schema).parquet(f"{out}/members").filter(F.col("epoch") == epoch)
        if members.isEmpty():
            log.info("epoch %d: read %d rows, none of them with a sample and a sequence", epoch, seen.get["rows"])
            return
        replace_partitions(counted(members, "epoch"), f"{out}/counts", "bucket", "epoch")
        counts = spark.read.parquet(f"{out}/counts")
        touched = [r[0] for r in counts.filter(F.col("epoch") == epoch).select("bucket").distinct().collect()]  # as many as there are buckets at most
        replace_partitions(families(counts.filter(F.col("bucket").isin(touched))), f"{out}/families", "bucket")
        log.info("epoch %d: read %d rows, wrote %d genes into members, rewrote %d of %d buckets of families", epoch, seen.get["rows"], members.count(), len(touched), c["buckets"])

    return run


def classified(spark: SparkSession, out: str, c: dict) -> DataFrame:
    """The families with their class, by the samples that have genes."""
    samples = spark.read.parquet(f"{out}/counts").select("sample_id").distinct().count()
    return report.classes(spark.read.parquet(f"{out}/families"), samples, c["core"], c["soft"], c["shell"])


def collect_families(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame | None:
    """Take what is new in ``source`` and return all families; None while nothing with a sample and a sequence has come."""
    c = settings("collect_families") | (config or {})
    rows = spark.read.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(_watched(rows, source))
    query = stream.select(c["gene"], c["sample"], c["sequence"]).writeStream.foreachBatch(take(spark, out, c)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p.numInputRows]
    log.info("%s: %d new batches, %d new rows", source, len(batches), sum(p.numInputRows for p in batches))
    try:
        found = classified(spark, out, c)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    counts = found.groupBy("class").agg(F.count("*").alias("families"), F.sum("n_sequences").alias("genes"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{out}/summary")
    for r in spark.read.parquet(f"{out}/summary").orderBy("class").collect():  # a row a class
        log.info("%s: %s has %d families of %d genes", out, r["class"], r["families"], r["genes"])
    return found


def _watched(rows: DataFrame, source: str) -> str:
    """A stream takes a folder or a pattern; a single file is the only one of its pattern."""
    one = rows.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name")).limit(1).collect()
    source = source.rstrip("/")
    return f"{source[:-1]}[{source[-1]}]" if one and one[0].name == source.rpartition("/")[2] else source


if __name__ == "__main__":
    command("collect_families", __doc__.partition("\n")[0], {"source": "table of sequences (Parquet files)", "out": "folder of the output", "checkpoint": "folder of the stream's checkpoint"}, collect_families)
