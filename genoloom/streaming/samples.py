"""Samples that arrive over time: each micro-batch of new GFF files is added to a saved collection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from genoloom import storage
from genoloom.plans.pipeline import Collection, Options, add, build
from genoloom.sources import genomes


def into_collection(spark: SparkSession, path: str, o: Options = Options()):
    """A function for ``foreachBatch`` over rows (gff_file). Samples already in the collection are passed over, so that a
    batch that runs again changes nothing. A collection needs two samples: files that come before it are noted in
    ``path``/waiting and make it with the first that give it two."""

    def run(batch: DataFrame, epoch: int) -> None:
        files = sorted(r[0] for r in batch.select("gff_file").distinct().collect())  # file names of one batch
        if not files:
            return
        old = Collection.load(spark, path) if storage.latest(spark, path) else None
        waiting = None
        if old is None:
            if storage.latest(spark, f"{path}/waiting"):
                waiting = [r[0] for r in spark.read.text(f"{path}/waiting/{storage.latest(spark, f'{path}/waiting')}").collect()]  # less than two
            files = sorted({*files, *(waiting or [])})
        samples = genomes.samples_from_paths(spark, files, old.samples if old else None)
        if old is None and samples.limit(2).count() < 2:
            version = uuid.uuid4().hex
            spark.createDataFrame([(f,) for f in files], "value string").write.text(f"{path}/waiting/{version}")
            storage.publish(spark, f"{path}/waiting", version)
        elif not samples.isEmpty():
            (add(old, samples, o) if old else build(samples, o)).save(path)

    return run


def watch(spark: SparkSession, folder: str, path: str, checkpoint: str, o: Options = Options()):
    """A streaming query over the GFF files of a folder."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.gff*").load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("gff_file"))
    return files.writeStream.foreachBatch(into_collection(spark, path, o)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
