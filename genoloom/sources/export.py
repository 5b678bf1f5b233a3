"""Writers of the files that users of such pipelines expect. Tables stay Parquet; these are exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from genoloom.functions.sequences import rounded
from genoloom.operators import report
from genoloom.sources import named_files

HEAD = ["Gene", "Annotation", "No. isolates", "No. sequences", "Avg sequences per isolate", "Min group size nuc", "Max group size nuc", "Avg group size nuc"]
SUMMARY = ("Core genes\t({core}% <= strains <= 100%)", "Soft core genes\t({soft}% <= strains <{core}.0%)", "Shell genes\t({shell}% <= strains < {soft}%)", "Cloud genes\t(0% <= strains < {shell}%)", "Total genes\t(0% <= strains <= 100%)")


def spreadsheet(families: DataFrame, samples: list[str]) -> DataFrame:
    """The presence/absence matrix as text columns: eight of figures, then one a sample with its genes joined by tabs."""
    members = report.members_of(families)
    cells = report.presence(members).withColumn("cell", F.array_join("gene_ids", "\t"))
    wide = report.pivoted(cells, samples, "cell", "")
    t = families.join(report.family_stats(members), families["name"] == F.col("family")).drop("family")
    t = t.select(
        F.col("family_ord"), F.col("name").alias("Gene"), F.col("product").alias("Annotation"), F.col("n_isolates").alias("No. isolates"), F.col("n_sequences").alias("No. sequences"),
        rounded(F.col("avg_per_isolate")).alias("Avg sequences per isolate"), F.col("min_length").alias("Min group size nuc"), F.col("max_length").alias("Max group size nuc"), F.bround("mean_length", 0).cast("long").alias("Avg group size nuc"),
    )
    return t.join(wide, t["Gene"] == wide["family"]).orderBy("family_ord").select(*[F.col(f"`{c}`") for c in HEAD], *[wide[f"`{s}`"] for s in samples])


def write_spreadsheet(families: DataFrame, samples: list[str], path: str) -> None:
    t = spreadsheet(families, samples)
    quoted = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in t.columns])
    head = ",".join('"' + c.replace('"', '""') + '"' for c in t.columns)
    lines = t.select(F.concat(quoted, F.lit("\r")).alias("value"))
    _text(lines.sparkSession.createDataFrame([(head + "\r",)], "value string"), lines, path)


def rtab(families: DataFrame, samples: list[str]) -> DataFrame:
    wide = report.pivoted(report.presence(report.members_of(families)), samples)
    return families.join(wide, families["name"] == wide["family"]).orderBy("family_ord").select(F.col("name").alias("Gene"), *[wide[f"`{s}`"] for s in samples])


def write_rtab(families: DataFrame, samples: list[str], path: str) -> None:
    t = rtab(families, samples)
    lines = t.select(F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in t.columns]).alias("value"))
    _text(lines.sparkSession.createDataFrame([("\t".join(t.columns),)], "value string"), lines, path)


def summary_lines(summary: DataFrame, core: float = report.CORE, soft: float = report.SOFT, shell: float = report.SHELL) -> list[str]:
    n = {r["class"]: r.n for r in summary.collect()}  # five rows
    words = {"core": f"{core * 100:g}", "soft": f"{soft * 100:g}", "shell": f"{shell * 100:g}"}
    return [f"{label.format(**words)}\t{n[c]}" for label, c in zip(SUMMARY, report.LABELS, strict=True)]


def fasta(t: DataFrame, header, seq) -> DataFrame:
    return t.select(F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value"))


def representative_fasta(families: DataFrame, seqs: DataFrame, column: str) -> DataFrame:
    """One record a family, in order of samples and their genes: ``>name gene, size samples``."""
    one = seqs.groupBy("gene_id").agg(F.min_by(column, "seq_ord").alias("seq"), F.min("seq_ord").alias("seq_ord"))
    t = families.join(one, families["representative"] == one["gene_id"]).orderBy("seq_ord", "family_ord")
    return fasta(t, F.concat("name", F.lit(" "), "representative", F.lit(", "), F.col("size").cast("string"), F.lit(" samples")), F.col("seq"))


def reference_fasta(families: DataFrame, seqs: DataFrame) -> DataFrame:
    """Nucleotides of the representatives of aligned families, under their own ids, in order of samples."""
    t = seqs.join(families.select("representative").distinct(), seqs["gene_id"] == F.col("representative"))
    return fasta(t.orderBy("seq_ord"), F.col("gene_id"), F.col("nt"))


def family_records(families: DataFrame, seqs: DataFrame, column: str, ending: str) -> DataFrame:
    """(file, ord, value): the records of each family's genes, in order of samples, for the file ``name/name.ending``."""
    of = families.select("name", F.explode("gene_ids").alias("gene_id"))
    return seqs.join(of, "gene_id").select(F.concat("name", F.lit("/"), "name", F.lit(f".{ending}")).alias("file"), F.col("seq_ord").alias("ord"), F.concat(F.lit(">"), "gene_id", F.lit("\n"), F.col(column)).alias("value"))


def alignment_records(aligned: DataFrame, seqs: DataFrame, ending: str) -> DataFrame:
    """The same of an alignment (family, gene_id, aligned)."""
    order = seqs.groupBy("gene_id").agg(F.min("seq_ord").alias("ord"))
    return aligned.join(order, "gene_id").select(F.concat("family", F.lit("/"), "family", F.lit(f".{ending}")).alias("file"), "ord", F.concat(F.lit(">"), "gene_id", F.lit("\n"), "aligned").alias("value"))


def sample_records(seqs: DataFrame, column: str, ending: str) -> DataFrame:
    """(file, ord, value): the records of each sample's genes, for the file ``id/id.ending``."""
    return seqs.select(F.concat("sample_id", F.lit("/"), "sample_id", F.lit(f".{ending}")).alias("file"), F.col("seq_ord").alias("ord"), F.concat(F.lit(">"), "gene_id", F.lit("\n"), F.col(column)).alias("value"))


def core_fasta(core: DataFrame) -> DataFrame:
    return fasta(core.orderBy("sample_ord"), F.col("sample_id"), F.col("aligned"))


def json_lines(t: DataFrame, key: str, value, brackets: str = "{}") -> DataFrame:
    """Lines of one JSON document, in the order of ``key``: an object of key and ``value``, or with other brackets a list."""
    entry = F.concat(F.regexp_replace(F.to_json(F.struct(F.col(key).alias("k"))), r'^\{"k":|\}$', ""), F.lit(": "), F.to_json(value)) if brackets == "{}" else F.to_json(value)
    first = t.agg(F.min(key)).first()[0]
    lines = t.orderBy(key).select(F.concat(F.when(F.col(key) == F.lit(first), "").otherwise(","), entry).alias("value"))
    ends = [t.sparkSession.createDataFrame([(x,)], "value string") for x in brackets]
    return ends[0].unionByName(lines).unionByName(ends[1])


def families_json(families: DataFrame) -> DataFrame:
    fields = ("product", "representative", "min_length", "max_length", "mean_length", "size")
    return json_lines(families, "name", F.struct(F.col("gene_ids").alias("gene_id"), *fields))


def clusters_json(clusters: DataFrame) -> DataFrame:
    t = clusters.groupBy("rep_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("member_id").isNotNull(), F.struct("member_ord", "member_id")))), lambda x: x["member_id"]).alias("m"))
    return json_lines(t, "rep_id", F.col("m"))


def samples_json(samples: DataFrame) -> DataFrame:
    return json_lines(samples, "sample_ord", F.struct(F.col("sample_id").alias("id"), "gff_file", F.coalesce("assembly", F.lit("")).alias("assembly")), "[]")


def annotation_lines(annotation: DataFrame, sep: str = ",", header: bool = True) -> DataFrame:
    cols = ["gene_id", "sample_id", "seq_id", "length", "gene_name", "gene_product", "gene_index", "strand"]
    t = annotation.orderBy("ann_ord").select(F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]).alias("value"))
    return t.sparkSession.createDataFrame([(sep.join(cols),)], "value string").unionByName(t) if header else t


def position_lines(positions: DataFrame) -> DataFrame:
    genes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "gene_id"))), lambda x: x["gene_id"])
    return positions.groupBy("sample_id", "seq_id").agg(F.array_join(genes, ",").alias("g")).orderBy("sample_id", "seq_id").select(F.concat_ws(",", "sample_id", "seq_id", "g").alias("value"))


def _text(head: DataFrame, lines: DataFrame, path: str) -> None:
    """One file in order, as the format has one header."""
    rows = head.withColumn("_k", F.lit(-1).cast("long")).unionByName(lines.withColumn("_k", F.monotonically_increasing_id()))
    folder, _, name = path.rpartition("/")
    named_files.write(rows.withColumn("file", F.lit(name)), folder, "_k")


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines as one file; a name that ends with .gz is compressed."""
    folder, _, name = path.rpartition("/")
    named_files.write(lines.withColumns({"_k": F.monotonically_increasing_id(), "file": F.lit(name)}), folder, "_k")
