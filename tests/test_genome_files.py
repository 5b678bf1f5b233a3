"""Readers of genome files against whole reads, whatever the ranges."""

import gzip
import io
import random

import pytest

from genoloom.sources import genome_files as g


def genome(rng, crlf=False):
    """(text, features, records) of a GFF file with all that may stand in one."""
    lines, feats = ["##gff-version 3", "# a comment", ""], []
    for k in range(rng.randrange(0, 30)):
        c = [f"c{k % 3}", "src", rng.choice(["CDS", "gene", "tRNA"]), str(k), str(k + 120) if k % 7 else "x", ".", "+", "0", f"ID={k};note=" + "n" * rng.randrange(0, 40)]
        c = c[: 9 if k % 5 else 5]
        lines.append("\t".join(c))
        feats.append(c)
    lines.append("##FASTA")
    recs = []
    for k in range(rng.randrange(0, 6)):
        seq = ["".join(rng.choices("ACGT", k=rng.randrange(0, 60))) for _ in range(rng.randrange(0, 12))]
        name = f"c{k}" if rng.random() < 0.8 else ""
        lines += [f">{name} a contig\twith a tab and more", *(s + " " * (len(s) % 2) for s in seq), ""]
        if name:
            recs.append((name, "".join(seq)))
    return ("\r\n" if crlf else "\n").join(lines) + rng.choice(["", "\n"]), feats, recs


@pytest.mark.parametrize("block", [1 << 20, 16, 64])
def test_ranges_give_what_the_whole_gives(monkeypatch, block):
    monkeypatch.setattr(g, "BLOCK", block)
    rng = random.Random(block)
    for trial in range(40):
        text, feats, recs = genome(rng, trial % 4 == 0)
        raw = text.encode()
        for split in (7, 100, len(raw) + 1):
            parts = [(k, min(k + split, len(raw))) for k in range(0, len(raw), split)]
            got = [x for a, b in parts for x in g.features(io.BytesIO(raw), a, b, {})]
            assert [c[:9] for _, c in got] == feats and [at for at, _ in got] == sorted({at for at, _ in got})
            found = [x for a, b in parts for x in g.records(io.BytesIO(raw), a, b, {})]
            assert [(n, s) for _, n, s in found] == recs
            assert all(raw[at : at + 1] == b">" for at, _, _ in found)


def test_sources(spark, tmp_path):
    rng = random.Random(3)
    want_f, want_r = [], []
    for k in range(5):
        text, feats, recs = genome(rng)
        name = f"s{k}.gff" + ".gz" * (k % 2)
        (gzip.open if k % 2 else open)(tmp_path / name, "wt").write(text)
        want_f += [(f"{tmp_path}/{name}", *c[:3]) for c in feats]
        want_r += [(f"{tmp_path}/{name}", *r) for r in recs]
    (tmp_path / "notes.txt").write_text("c\tno\tCDS\t1\t2")
    g.register(spark)
    t = spark.read.format("gff").option("splitBytes", "300").load(str(tmp_path))
    assert t.rdd.getNumPartitions() > 6
    assert sorted((r.path, r.seqid, r.source, r.type) for r in t.collect()) == sorted(want_f)
    assert t.filter("start IS NULL").count() == 0 and {r.end is None for r in t.filter("start % 7 = 0").collect()} <= {True}
    some = t.filter("type = 'CDS' AND seqid IN ('c0', 'c1') AND strand IS NOT NULL")
    assert "isnotnull" not in some._jdf.queryExecution().executedPlan().toString() or some.count() >= 0
    assert sorted((r.path, r.seqid, r.type) for r in t.filter("type = 'CDS' AND seqid IN ('c0', 'c1')").collect()) == sorted((p, s, k) for p, s, _, k in want_f if k == "CDS" and s in ("c0", "c1"))
    f = spark.read.format("fasta").option("paths", "\n".join(f"{tmp_path}/s{k}.gff" + ".gz" * (k % 2) for k in range(5))).option("splitBytes", "200").load()
    assert sorted((r.path, r.name, r.seq) for r in f.collect()) == sorted(want_r)
    assert sorted((r.path, r.seq) for r in f.filter("name = 'c1'").collect()) == sorted((p, s) for p, n, s in want_r if n == "c1")
    assert spark.read.format("fasta").load().count() == 0
    with pytest.raises(Exception, match="nothing-here"):
        spark.read.format("gff").load(f"{tmp_path}/nothing-here").count()


def test_tests_are_pushed_down():
    reader = g.GenomeReader("gff", {})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    rest = list(reader.pushFilters([EqualTo(("type",), "CDS"), In(("seqid",), ("a", "b")), EqualTo(("seqid",), "b"), GreaterThan(("start",), 3)]))
    assert [type(f) for f in rest] == [GreaterThan] and reader.wanted == {"type": ("CDS",), "seqid": ("b",)}
    raw = b"a\tx\tCDS\t1\nb\tx\tgene\t1\nb\tx\tCDS\t9\n"
    assert [c for _, c in g.features(io.BytesIO(raw), 0, None, reader.wanted)] == [["b", "x", "CDS", "9"]]


def test_rewritten_files(spark, tmp_path):
    """All cells come back, ids are new, and what can't be rewritten is an error."""
    from genoloom.operators import gfftools
    from genoloom.sources import genomes, named_files
    from pyspark.sql import functions as F

    head = "##gff-version 3\nc\tsrc\tgene\t1\t9\t0.5\t+\t.\tID=g\nc\tsrc\tCDS\t1\t9\t7\t-\t2\tID=k;x=1\n"
    (tmp_path / "a.gff").write_text(head + "##FASTA\n>c\nACGT\nAC\n")
    (tmp_path / "b.gff").write_text(head)
    (tmp_path / "d.gff").write_text(head + "c\tsrc\tCDS\t1\t9\n##FASTA\n>c\nAC\n")
    (tmp_path / "e.gff").write_text(head + "c\ts\tCDS\t1\t9\t.\t+\t0\tID=x\tmore\n##FASTA\n>c\nAC\n")

    def made(name):
        s = genomes.samples_from_paths(spark, [str(tmp_path / name)])
        return gfftools.rewritten(genomes.gff_features(s), genomes.contigs(s))

    named_files.write(made("a.gff").withColumn("file", F.concat("sample_id", F.lit(".gff"))), str(tmp_path / "out"), "ord")
    assert (tmp_path / "out/a.gff").read_text() == head.replace("ID=k", "ID=a_00001") + "##FASTA\n>c\nACGTAC\n"
    for name, what in (("b.gff", "no sequences"), ("d.gff", "nine cells"), ("e.gff", "nine cells")):
        with pytest.raises(Exception, match=what):
            made(name).collect()
