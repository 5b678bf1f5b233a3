"""From GFF features and contigs to annotated, placed and translated genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from genoloom.functions import sequences as q


def coding(features: DataFrame, min_protein_len: int = 40) -> DataFrame:
    """Coding features long enough and of whole codons, with their length and contig id."""
    t = features.filter("type = 'CDS'").withColumn("length", F.col("end") - F.col("start") + 1)
    return t.filter((F.col("length") >= 3 * min_protein_len) & (F.col("length") % 3 == 0)).withColumn("seq_id", q.no_dash(F.col("seqid")))


def with_runs(cds: DataFrame) -> DataFrame:
    """Adds run: the number of contig changes up to a row, of all candidates of the sample in file order."""
    w = Window.partitionBy("sample_id").orderBy("line_no")
    changed = F.coalesce((F.col("seq_id") != F.lag("seq_id").over(w)).cast("int"), F.lit(1))
    return cds.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w)).drop("changed")


def identified(cds: DataFrame) -> DataFrame:
    """Rows with an id, their attributes and place: the candidates of ``with_runs`` go in."""
    t = cds.withColumns({"raw_id": q.attribute(F.col("attrs"), "ID"), "gene_name": F.coalesce(q.clean_name(q.attribute(F.col("attrs"), "gene")), F.lit("")), "gene_product": F.coalesce(q.attribute(F.col("attrs"), "product"), F.lit(""))})
    t = t.filter("raw_id is not null").withColumn("gene_id", q.canonical_gene_id(F.col("raw_id"), F.col("sample_id"), F.col("seq_id")))
    run = Window.partitionBy("sample_id", "run").orderBy("line_no")
    place = Window.partitionBy("sample_id", "seq_id").orderBy("line_no")
    return t.select("sample_id", "line_no", "gene_id", "seq_id", (F.col("start") - 1).alias("start0"), "end", "length", "strand", "gene_name", "gene_product", (F.row_number().over(run) - 1).alias("gene_index"), (F.row_number().over(place) - 1).alias("pos"))


def genes(features: DataFrame, min_protein_len: int = 40) -> DataFrame:
    return identified(with_runs(coding(features, min_protein_len)))


def annotation(g: DataFrame, samples: DataFrame) -> DataFrame:
    """One row a gene id: the last value, at the place of the first; ann_ord orders by sample and place."""
    t = g.groupBy("sample_id", "gene_id").agg(F.min("line_no").alias("first"), F.max_by(F.struct("seq_id", "length", "gene_name", "gene_product", "gene_index", "strand"), "line_no").alias("v"))
    t = t.join(samples.select("sample_id", "sample_ord"), "sample_id")
    # places in a file are less than 2^40, so the pair orders as one number
    return t.select((F.col("sample_ord") * F.lit(1 << 40) + F.col("first")).alias("ann_ord"), "gene_id", "sample_id", "v.*")


def positions(g: DataFrame) -> DataFrame:
    return g.select("sample_id", "seq_id", "pos", "gene_id")


def gene_sequences(g: DataFrame, contigs: DataFrame, table: int = 11) -> DataFrame:
    """gene_id, sample_id, line_no, nt, aa of the genes that lie on a contig; a contig's text is joined once, with all its genes."""
    own = g.groupBy("sample_id", F.col("seq_id").alias("contig_id")).agg(F.collect_list(F.struct("line_no", "gene_id", "start0", "end", "strand")).alias("gs"))
    t = own.join(contigs, ["sample_id", "contig_id"])
    inside = F.filter("gs", lambda x: x["end"] <= F.length("seq"))
    cut = F.transform(inside, lambda x: F.struct(x["line_no"].alias("line_no"), x["gene_id"].alias("gene_id"), q.stranded(q.slice_bases(F.col("seq"), x["start0"], x["end"]), x["strand"]).alias("nt")))
    t = t.select("sample_id", F.explode(cut).alias("x")).select("sample_id", "x.*")
    return t.withColumn("aa", q.translate_cds(F.col("nt"), table))


def combined(seqs: DataFrame, samples: DataFrame) -> DataFrame:
    """gene_seq: sequences of all samples with seq_ord, which orders by sample and place; no global sort is needed."""
    t = seqs.join(samples.select("sample_id", "sample_ord"), "sample_id")
    return t.select((F.col("sample_ord") * F.lit(1 << 40) + F.col("line_no")).alias("seq_ord"), "gene_id", "sample_id", "nt", "aa")


def neighbours(positions_: DataFrame, reach: int = 5) -> DataFrame:
    """Adds neighbours: up to ``reach`` genes before and after on the contig."""
    w = Window.partitionBy("sample_id", "seq_id").orderBy("pos")
    return positions_.withColumn("neighbours", F.concat(F.collect_list("gene_id").over(w.rowsBetween(-reach, -1)), F.collect_list("gene_id").over(w.rowsBetween(1, reach))))


def only(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    """Sequences whose gene_id is in ``ids``."""
    return seqs.join(ids.select("gene_id").distinct(), "gene_id", "left_semi")


def without(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    """Sequences whose gene_id is not in ``ids``."""
    return seqs.join(ids.select("gene_id").distinct(), "gene_id", "left_anti")
