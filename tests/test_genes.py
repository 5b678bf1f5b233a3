import gzip

import pytest

from genoloom.operators import genes
from genoloom.sources import genomes


def features(spark, rows):
    """rows: (seqid, type, start, end, strand, attrs)."""
    return spark.createDataFrame([("s", n, *r) for n, r in enumerate(rows)], "sample_id string, line_no int, seqid string, type string, start int, end int, strand string, attrs string")


def test_filters(spark):
    f = features(spark, [("c", "CDS", 1, 117, "+", "ID=a"), ("c", "CDS", 1, 120, "+", "ID=b"), ("c", "CDS", 1, 121, "+", "ID=c"), ("c", "gene", 1, 120, "+", "ID=d"), ("c", "CDS", 1, 120, "+", "x=1")])
    assert [r.gene_id for r in genes.genes(f).collect()] == ["s-c-b"]


def test_runs_restart_and_places_do_not(spark):
    f = features(spark, [("a", "CDS", 1, 120, "+", "ID=1"), ("b", "CDS", 1, 120, "+", "ID=2"), ("a", "CDS", 1, 120, "+", "ID=3"), ("a", "CDS", 1, 120, "+", "ID=4"), ("b-", "CDS", 1, 120, "+", "note=1"), ("a", "CDS", 1, 120, "+", "ID=5")])
    got = {r.gene_id: (r.gene_index, r.pos) for r in genes.genes(f).collect()}
    assert got == {"s-a-1": (0, 0), "s-b-2": (0, 0), "s-a-3": (0, 1), "s-a-4": (1, 2), "s-a-5": (0, 3)}


def test_repeated_ids(spark):
    f = features(spark, [("a", "CDS", 1, 120, "+", "ID=1;gene=x"), ("a", "CDS", 1, 123, "+", "ID=2"), ("a", "CDS", 1, 126, "-", "ID=1;gene=y")])
    samples = spark.createDataFrame([(0, "s", "f", None)], "sample_ord long, sample_id string, gff_file string, assembly string")
    g = genes.genes(f)
    rows = genes.annotation(g, samples).orderBy("ann_ord").collect()
    assert [(r.gene_id, r.length, r.gene_name) for r in rows] == [("s-a-1", 126, "y"), ("s-a-2", 123, "")]
    assert genes.positions(g).count() == 3


def test_sequences_need_their_contig(spark):
    f = features(spark, [("a", "CDS", 1, 120, "+", "ID=1"), ("a", "CDS", 1, 300, "+", "ID=2"), ("z", "CDS", 1, 120, "-", "ID=3")])
    c = spark.createDataFrame([("s", "a", "ATG" * 50)], "sample_id string, contig_id string, seq string")
    rows = genes.gene_sequences(genes.genes(f), c).collect()
    assert [(r.gene_id, r.aa) for r in rows] == [("s-a-1", "M" * 40)]


def test_files(spark, tmp_path):
    gff = "#c\n\nx-1\ts\tCDS\t1\t120\t.\t+\t0\tID=1\n##FASTA\n>x-1 d\n" + "ATG" * 40 + "\n"
    (tmp_path / "a-1.gff").write_text(gff)
    with gzip.open(tmp_path / "b.GFF3.gz", "wt") as f:
        f.write(gff)
    (tmp_path / "b.fa").write_text(">x-1\n" + "GGG" * 40)
    s = genomes.samples_from_paths(spark, [str(tmp_path / "a-1.gff"), str(tmp_path / "b.GFF3.gz")])
    assert [r.sample_id for r in s.orderBy("sample_ord").collect()] == ["a_1", "b"]
    g = genes.genes(genomes.gff_features(s))
    assert sorted(r.gene_id for r in g.collect()) == ["a_1-x_1-1", "b-x_1-1"]
    assert {r.aa for r in genes.gene_sequences(g, genomes.contigs(s)).collect()} == {"M" * 40}
    (tmp_path / "list.tsv").write_text(f"a-1\t{tmp_path}/a-1.gff\t{tmp_path}/b.fa\na-1\t{tmp_path}/x.gff\t\n")
    s = genomes.samples_from_table(spark, str(tmp_path / "list.tsv"))
    assert [(r.sample_id, r.assembly is None) for r in s.collect()] == [("a_1", False)]
    c = genomes.contigs(s).collect()  # the assembly goes before the tail
    assert [(r.contig_id, r.seq[:3]) for r in c] == [("x_1", "GGG")]


def test_guards(spark):
    with pytest.raises(ValueError):
        genomes.samples_from_paths(spark, ["a.txt"])
    s = genomes.samples_from_paths(spark, ["a.gff"])
    with pytest.raises(ValueError):
        genomes.require(s, 2)
    assert genomes.samples_from_paths(spark, ["a.gff", "b.gff"], s).collect()[0].sample_ord == 1
