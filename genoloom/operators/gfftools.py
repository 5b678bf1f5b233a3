"""Rewriting GFF files, and exports with numeric ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from genoloom.functions.sequences import attribute


def valid(lines: DataFrame) -> DataFrame:
    """file, valid, of (file, in_fasta, line): features have at least eight cells, sequence lines only nucleotide letters."""
    feature = F.startswith("line", F.lit("#")) | (F.size(F.split("line", "\t")) >= 8)
    sequence = F.startswith("line", F.lit(">")) | F.col("line").rlike("^[CAGTNSYKcagtnsyk]+$")
    return lines.groupBy("file").agg(F.bool_and(F.when(F.col("in_fasta"), sequence).otherwise(feature)).alias("valid"))


def locus(features: DataFrame) -> DataFrame:
    """Adds locus: it grows where (seqid, start, end) is not that of the line before."""
    w = Window.partitionBy("sample_id").orderBy("line_no")
    key = F.struct("seqid", "start", "end")
    return features.withColumn("new", F.coalesce((key != F.lag(key).over(w)).cast("int"), F.lit(1))).withColumn("locus", F.sum("new").over(w)).drop("new")


def normalised(features: DataFrame) -> DataFrame:
    """Ids become sample-contig-locus-old id, and a Parent that is the id of the line before becomes its new id."""
    t = locus(features).withColumn("old_id", attribute(F.col("attrs"), "ID"))
    t = t.withColumn("new_id", F.concat_ws("-", "sample_id", F.translate("seqid", "-", "_"), F.col("locus").cast("string"), "old_id"))
    w = Window.partitionBy("sample_id").orderBy("line_no")
    parent = attribute(F.col("attrs"), "Parent")
    t = t.withColumn("new_parent", F.when(parent == F.lag("old_id").over(w), F.lag("new_id").over(w)).otherwise(parent))
    tags = F.slice(F.split("attrs", ";"), 3, 1 << 30)
    head = F.concat(F.lit("ID="), "new_id", F.when(F.col("new_parent").isNotNull(), F.concat(F.lit(";Parent="), "new_parent")).otherwise(F.lit("")))
    return t.withColumn("attrs", F.concat(head, F.when(F.size(tags) > 0, F.concat(F.lit(";"), F.array_join(tags, ";"))).otherwise(F.lit("")))).drop("new_parent")


def renumbered(features: DataFrame) -> DataFrame:
    """Coding features get ID=sample_00001 and on, in file order, in the place of the first ID they have or else last; others keep
    their attributes."""
    w = Window.partitionBy("sample_id").orderBy("line_no")
    n = F.sum((F.col("type") == "CDS").cast("int")).over(w)
    tags = F.split("attrs", ";")
    new = F.concat(F.lit("ID="), "sample_id", F.format_string("_%05d", "n"))
    at = F.coalesce(F.array_position(F.transform(tags, lambda a: a.rlike("^ID=.")), F.lit(True)), F.lit(0)).cast("int")
    put = F.when(at > 0, F.transform(tags, lambda a, i: F.when(i + 1 == at, new).otherwise(a))).otherwise(F.concat(tags, F.array(new)))
    return features.withColumn("n", n).withColumn("attrs", F.when(F.col("type") == "CDS", F.array_join(put, ";")).otherwise(F.col("attrs"))).drop("n")


def gff_text(features: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """(sample_id, ord, value): lines of GFF files, and after ``##FASTA`` the contigs where they are given. Cells that the features lack
    are written as none, the phase of coding ones as 0."""
    cell = lambda c, none=".": F.coalesce(F.col(c).cast("string"), F.lit(none)) if c in features.columns else F.lit(none)
    phase = F.when(F.col("type") == "CDS", cell("phase", "0")).otherwise(cell("phase"))
    line = F.concat_ws("\t", cell("seqid"), cell("source"), cell("type"), cell("start"), cell("end"), cell("score"), cell("strand"), phase, cell("attrs"))
    out = features.select("sample_id", F.struct(F.lit(1).alias("part"), F.col("line_no").cast("long").alias("n"), F.lit("").alias("c")).alias("ord"), line.alias("value"))
    heads = [(0, "##gff-version 3")] + ([(2, "##FASTA")] if contigs is not None else [])
    for part, text in heads:
        out = out.unionByName(features.select("sample_id").distinct().select("sample_id", F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("n"), F.lit("").alias("c")).alias("ord"), F.lit(text).alias("value")))
    if contigs is not None:
        out = out.unionByName(contigs.select("sample_id", F.struct(F.lit(3).alias("part"), F.lit(0).cast("long").alias("n"), F.col("contig_id").alias("c")).alias("ord"), F.concat(F.lit(">"), "contig_id", F.lit("\n"), "seq").alias("value")))
    return out


def rewritten(features: DataFrame, contigs: DataFrame) -> DataFrame:
    """``gff_text`` of features with new ids. A line of other than nine cells, and a sample without sequences, are errors, as other tools would fail on
    what is written."""
    wrong = F.raise_error(F.concat("sample_id", F.lit(": the feature at "), F.col("line_no").cast("string"), F.lit(" has not nine cells"))).cast("string")
    checked = features.withColumn("attrs", F.when(F.col("attrs").isNull() | (F.col("cells") != 9), wrong).otherwise(F.col("attrs")))
    has = contigs.select("sample_id", F.lit(True).alias("has")).distinct()
    none = F.raise_error(F.concat("sample_id", F.lit(": no sequences"))).cast("string")
    out = gff_text(renumbered(checked), contigs).join(has, "sample_id", "left")
    return out.select("sample_id", "ord", F.when(F.col("has"), F.col("value")).otherwise(none).alias("value"))


def tagged(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """Adds pangenome_id to coding features whose id is in a cluster (sample_id, gene_id, cluster_no); others pass as they are."""
    t = features.withColumn("gene_id", attribute(F.col("attrs"), "ID")).join(clusters.select("sample_id", "gene_id", "cluster_no"), ["sample_id", "gene_id"], "left")
    on = (F.col("type") == "CDS") & F.col("cluster_no").isNotNull()
    return t.withColumn("attrs", F.when(on, F.concat("attrs", F.lit(";pangenome_id="), F.col("cluster_no").cast("string"))).otherwise(F.col("attrs"))).drop("gene_id", "cluster_no")


def numeric_export(annotation: DataFrame, positions: DataFrame, families: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, gene_info, gene_position) with numbers for samples and for families in order of their names; a gene of
    no family or sample is an error in gene_info."""
    from genoloom.operators.families import numbered

    s = samples.select("sample_id", F.col("sample_ord").alias("sample_no"))
    names = numbered(families.select(F.col("name").alias("key")), ["key"]).select(F.col("cluster_idx").alias("cluster_no"), F.col("key").alias("name"))
    of = families.join(names, "name").select("cluster_no", F.explode("gene_ids").alias("gene_id"))
    info = annotation.join(s, "sample_id", "left").join(of, "gene_id", "left")
    lost = F.when(F.col("cluster_no").isNull() | F.col("sample_no").isNull(), F.raise_error(F.concat(F.lit("no family or sample of "), "gene_id")).cast("int"))
    info = info.withColumn("cluster_no", F.coalesce(lost.cast("long"), "cluster_no")).select(F.concat("gene_id", F.lit("@"), F.when(F.col("strand") == "-", "-1").otherwise("1")).alias("gene"), "sample_no", "cluster_no", "ann_ord")
    strand = annotation.select("gene_id", F.when(F.col("strand") == "-", "-1").otherwise("1").alias("sign"))
    place = positions.join(strand, "gene_id").join(s, "sample_id").groupBy("sample_no", "seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("gene_id", F.lit("@"), "sign").alias("g")))), lambda x: x["g"]), ";").alias("genes"))
    return s, info, place


def catalogue(t: DataFrame) -> DataFrame:
    """Assemblies that have a link and aren't complete genomes under 5 Mb."""
    return t.na.drop(subset=["RefSeq FTP"]).filter(~((F.col("`Size(Mb)`") < 5) & (F.col("Level") == "Complete")))


def releases(t: DataFrame, column: str = "Release Date") -> DataFrame:
    """year, quarter, month, n: counts by month, by quarter with month null, and by year with both null."""
    d = F.to_timestamp(F.col(f"`{column}`"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if t.schema[column].dataType.simpleString() == "string" else F.col(f"`{column}`")
    return t.select(F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month")).rollup("year", "quarter", "month").agg(F.count("*").alias("n")).filter("year is not null")
