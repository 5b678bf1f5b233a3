"""The three plans: a new collection, more samples for a saved one, and alignments."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from genoloom import storage
from genoloom.operators import annotate, families, genes, graphs, hits, msa, paralogs, report, similarity
from genoloom.sources import export, genomes, named_files
from genoloom.storage import checkpoint

#: Parts of a table, after which a version writes it whole again.
PARTS = 64
TABLES = ("samples", "gene_annotation", "gene_position", "gene_seq", "dedup", "hits", "clusters", "families")


@dataclass(frozen=True)
class Options:
    dont_split: bool = False
    identity: float = 0.7
    length_difference: float = 0.7
    coverage_long: float = 0.0
    coverage_short: float = 0.0
    evalue: float = 1e-6
    table: int = 11
    min_protein_len: int = 40
    alignment: str | None = None
    ratio_coverage: float = 0.0
    core: float = report.CORE
    soft: float = report.SOFT
    shell: float = report.SHELL
    weight: str = "bitscore"

    def clustering(self) -> list:
        """What the clusters of the same hits depend on."""
        return [self.identity, self.length_difference, self.coverage_short, self.coverage_long, self.weight]


@dataclass(frozen=True)
class Collection:
    """The tables of a collection."""

    samples: DataFrame
    gene_annotation: DataFrame
    gene_position: DataFrame
    gene_seq: DataFrame
    dedup: DataFrame
    hits: DataFrame
    #: Components of the similarity graph and clusters in them (root, cluster, gene_id), and the options that they follow from.
    clusters: DataFrame
    families: DataFrame
    clustering: list = field(default_factory=list)

    #: Of a saved collection: its folder, the number of its version, and the parts of each table; rows that came since.
    home: str | None = None
    number: int | None = None
    parts: dict[str, list[str]] = field(default_factory=dict)
    fresh: dict[str, DataFrame] = field(default_factory=dict)

    def save(self, path: str) -> None:
        """Write a version, then a note that names its parts; a reader never sees half a collection, and a writer that ends half way leaves
        the version before. Into the folder that it was loaded from, of tables that only grew the new rows are written, and
        the parts before are shared; where another writer was there meanwhile, this is a ``storage.Conflict``."""
        spark, same = self.samples.sparkSession, self.home == path
        number = self.number if same else storage.current(spark, path)[0]
        version, parts = uuid.uuid4().hex, {}
        for t in TABLES:
            own, at = self.parts.get(t, []), f"{version}/{t}"
            grows = same and t in self.fresh and 0 < len(own) < PARTS
            (self.fresh[t] if grows else getattr(self, t)).write.parquet(f"{path}/{at}")
            parts[t] = [*own, at] if grows else [at]
        storage.publish(spark, path, json.dumps({"parts": parts, "clustering": self.clustering}), number)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Collection:
        number, note = storage.current(spark, path)
        if note is None:
            raise FileNotFoundError(f"no collection in {path}")
        note = json.loads(note)
        tables = {t: spark.read.parquet(*(f"{path}/{x}" for x in note["parts"][t])) for t in TABLES}
        return Collection(**tables, clustering=note["clustering"], home=path, number=number, parts=note["parts"])

    @staticmethod
    def clean(spark: SparkSession, path: str, keep: int = 1) -> None:
        """Remove what the last ``keep`` versions don't need."""
        storage.clean(spark, path, lambda note: {x.partition("/")[0] for own in json.loads(note)["parts"].values() for x in own}, keep)


def extract(samples: DataFrame, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotation, positions, sequences) of all genes of the samples."""
    g = checkpoint(genes.genes(genomes.gff_features(samples), o.min_protein_len))
    seqs = genes.gene_sequences(g, genomes.contigs(samples), o.table)
    return genes.annotation(g, samples), genes.positions(g), checkpoint(genes.combined(seqs, samples))


def _named(seqs: DataFrame) -> DataFrame:
    return seqs.select("gene_id", "aa")


def _edges(found: DataFrame, o: Options) -> DataFrame:
    return graphs.edges_of(hits.filtered(found, o.identity, o.length_difference, o.coverage_short, o.coverage_long), o.weight)


def _reclustered(old: Collection, own: DataFrame, every: DataFrame, o: Options) -> DataFrame:
    """The clusters of all hits, of those saved where the new ones (``own``) touch nothing; all anew under other options."""
    if old.clustering != o.clustering():
        return graphs.flowed(_edges(every, o))
    # self scores of saved genes count for weights that are ratios
    selves = old.hits.filter("qseqid = sseqid")
    names = own.select(F.least("qseqid", "sseqid").alias("a"), F.greatest("qseqid", "sseqid").alias("b")).distinct()
    new = checkpoint(_edges(own.unionByName(selves), o).join(names, ["a", "b"], "left_semi"))
    return graphs.reflowed(old.clusters, _edges(old.hits, o), new)


def _families(membership: DataFrame, annotation: DataFrame, positions: DataFrame, o: Options) -> DataFrame:
    split = paralogs.split_paralogs(checkpoint(membership), positions, o.dont_split)
    return checkpoint(annotate.annotated(split, annotation))


def build(samples: DataFrame, o: Options = Options()) -> Collection:
    """A collection of at least two samples."""
    genomes.require(samples, 2)
    annotation, positions, seqs = extract(samples, o)
    annotation, positions = checkpoint(annotation), checkpoint(positions)
    dedup = checkpoint(similarity.near_identical(seqs))
    reps = _named(seqs).join(dedup.select(F.col("rep_id").alias("gene_id")).distinct(), "gene_id", "left_semi").dropDuplicates(["gene_id"])
    found = checkpoint(similarity.search(reps, reps, o.evalue))
    clusters = checkpoint(graphs.flowed(_edges(found, o)))
    membership = families.reinflated(graphs.ordered(clusters), dedup)
    return Collection(samples, annotation, positions, seqs, dedup, found, clusters, _families(membership, annotation, positions, o), o.clustering())


def add(old: Collection, samples: DataFrame, o: Options = Options()) -> Collection:
    """A collection with more samples. Saved hits are used as they are; only new genes are searched, against saved
    representatives and each other."""
    genomes.require(samples, 1)
    annotation, positions, seqs = extract(samples, o)
    old_reps = old.gene_seq.join(old.dedup.select(F.col("rep_id").alias("gene_id")).distinct(), "gene_id", "left_semi")
    matched, rest = similarity.matched_to(seqs, old_reps.select("seq_ord", "gene_id", "aa"))
    matched, rest = checkpoint(matched), checkpoint(rest)
    fresh = checkpoint(similarity.near_identical(rest))
    new_reps = _named(seqs).join(fresh.select(F.col("rep_id").alias("gene_id")).distinct(), "gene_id", "left_semi").dropDuplicates(["gene_id"])
    saved = _named(old_reps).dropDuplicates(["gene_id"])
    own = checkpoint(hits.combined(similarity.search(new_reps, saved, o.evalue), similarity.search(new_reps, new_reps, o.evalue)))
    fresh_rows = {"samples": samples, "gene_annotation": checkpoint(annotation), "gene_position": checkpoint(positions), "gene_seq": seqs, "hits": own}
    grown = {t: getattr(old, t).unionByName(rows) for t, rows in fresh_rows.items()}
    clusters = checkpoint(_reclustered(old, own, grown["hits"], o))
    membership = families.reinflated_add(graphs.ordered(clusters), old.dedup, matched, fresh)
    return replace(
        old,
        **grown,
        fresh=fresh_rows,
        clusters=clusters,
        clustering=o.clustering(),
        dedup=checkpoint(families.merged_clusters(old.dedup, matched, fresh)),
        families=_families(membership, grown["gene_annotation"], grown["gene_position"], o),
    )


def sample_names(c: Collection) -> list[str]:
    """In order; the list of samples is the command's own input."""
    return [r[0] for r in c.samples.orderBy("sample_ord").select("sample_id").collect()]


def summary(c: Collection, o: Options = Options()) -> DataFrame:
    stats = report.family_stats(report.members_of(c.families))
    return report.summary(stats, c.samples.count(), o.core, o.soft, o.shell)


def align(c: Collection, o: Options, saved: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Alignments of families of enough genes, and of the core. Of ``saved`` alignments (family, gene_id, aligned), those of
    families that have the same genes are taken as they are."""
    large = checkpoint(report.large_families(c.families, c.samples.count(), o.ratio_coverage))
    of = large.select(F.col("name").alias("family"), F.explode("gene_ids").alias("gene_id"))
    seqs = c.gene_seq.groupBy("gene_id").agg(F.min_by("nt", "seq_ord").alias("nt"), F.min_by("aa", "seq_ord").alias("aa"))
    own = of.join(seqs, "gene_id")

    def aligned(kind: str, column: str) -> DataFrame:
        todo, old = own.select("family", "gene_id", F.col(column).alias("seq")), (saved or {}).get(kind)
        if old is None:
            return checkpoint(msa.family_alignments(todo, kind == "protein"))
        same = checkpoint(msa.unchanged(old, of))
        new = msa.family_alignments(todo.join(same, "family", "left_anti"), kind == "protein")
        return checkpoint(old.join(same, "family", "left_semi").select("family", "gene_id", "aligned").unionByName(new))

    out = {}
    if o.alignment == "protein":
        out["protein"] = aligned("protein", "aa")
        out["nucleotide"] = checkpoint(msa.codon_alignments(out["protein"], own))
    else:
        out["nucleotide"] = aligned("nucleotide", "nt")
    out["core"] = msa.core_alignment(out["nucleotide"], large.select(F.col("name").alias("family"), "family_ord"), c.samples)
    return out


def write_outputs(c: Collection, path: str, o: Options = Options()) -> None:
    """The exports of a collection, and its alignments where they are asked for."""
    spark, names = c.samples.sparkSession, sample_names(c)
    export.write_spreadsheet(c.families, names, f"{path}/gene_presence_absence.csv")
    export.write_rtab(c.families, names, f"{path}/gene_presence_absence.Rtab")
    lines = export.summary_lines(summary(c, o), o.core, o.soft, o.shell)
    export.write_lines(spark.createDataFrame([("\n".join(lines),)], "value string"), f"{path}/summary_statistics.txt")
    export.write_lines(export.representative_fasta(c.families, c.gene_seq, "nt"), f"{path}/representative_clusters_nucl.fasta")
    export.write_lines(export.representative_fasta(c.families, c.gene_seq, "aa"), f"{path}/representative_clusters_prot.fasta")
    export.write_lines(export.annotation_lines(c.gene_annotation), f"{path}/gene_annotation.csv")
    export.write_lines(export.position_lines(c.gene_position), f"{path}/gene_position.csv")
    export.write_lines(export.samples_json(c.samples), f"{path}/samples.json")
    export.write_lines(export.clusters_json(c.dedup), f"{path}/clusters.json")
    export.write_lines(export.families_json(c.families), f"{path}/annotated_clusters.json")
    named_files.write(export.sample_records(c.gene_seq, "nt", "fna").unionByName(export.sample_records(c.gene_seq, "aa", "faa")), f"{path}/samples", "ord", mode="overwrite")
    if o.alignment:
        at = f"{path}/alignment_tables"
        version, new = storage.latest(spark, at), uuid.uuid4().hex
        kinds = ("protein", "nucleotide") if o.alignment == "protein" else ("nucleotide",)
        saved = {kinds[0]: spark.read.parquet(f"{at}/{version}")} if version and version.startswith(o.alignment) else None
        done = align(c, o, saved)
        done[kinds[0]].write.parquet(f"{at}/{o.alignment}-{new}")
        storage.publish(spark, at, f"{o.alignment}-{new}")
        large = checkpoint(report.large_families(c.families, len(names), o.ratio_coverage))
        endings = {"nucleotide": ("nt", "fna"), "protein": ("aa", "faa")}
        records = [r for kind in kinds for r in (export.family_records(large, c.gene_seq, *endings[kind]), export.alignment_records(done[kind], c.gene_seq, f"{endings[kind][1]}.aln"))]
        named_files.write(reduce(DataFrame.unionByName, records), f"{path}/clusters", "ord", mode="overwrite")
        export.write_lines(export.reference_fasta(large, c.gene_seq), f"{path}/pan_genome_reference.fna")
        export.write_lines(export.core_fasta(done["core"]), f"{path}/core_gene_alignment.aln.gz")
