import gzip
import random
from dataclasses import replace

import genome
import pytest

from pyspark.sql import functions as F

from genoloom import cli, storage
from genoloom.functions import alignment
from genoloom.operators import gfftools
from genoloom.plans.pipeline import Collection, Options, align, sample_names, write_outputs
from genoloom.sources import tables


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("genomes"), random.Random(5)
    genes = [(f"g{chr(97 + i)}", genome.protein(rng, rng.randint(60, 110))) for i in range(8)]
    genome.write(at / "A.gff", rng, genes)
    genome.write(at / "B.gff", rng, genes[:6], 0.04)
    genome.write(at / "C.gff", rng, [*genes[:7], ("new", genome.protein(rng, 80))], 0.04)
    genome.write(at / "D.gff", rng, [*genes[2:], ("late", genome.protein(rng, 70))], 0.04)
    cli.main(["main", "-g", *(str(at / f"{s}.gff") for s in "ABC"), "-o", str(at / "out"), "-a", "protein"], spark)
    return at


def text(file) -> str:
    return file.read_bytes().decode()


def test_main(spark, made):
    lines = text(made / "out/gene_presence_absence.Rtab").splitlines()
    assert lines[0] == "Gene\tA\tB\tC"
    assert {x.split("\t")[0]: x.split("\t")[1:] for x in lines[1:]} == {**{f"g{c}": ["1", "1", "1"] for c in "abcdef"}, "gg": ["1", "0", "1"], "gh": ["1", "0", "0"], "new": ["0", "0", "1"]}
    assert text(made / "out/summary_statistics.txt").splitlines() == ["Core genes\t(99% <= strains <= 100%)\t6", "Soft core genes\t(95% <= strains <99.0%)\t0", "Shell genes\t(15% <= strains < 95%)\t3", "Cloud genes\t(0% <= strains < 15%)\t0", "Total genes\t(0% <= strains <= 100%)\t9"]
    sheet = text(made / "out/gene_presence_absence.csv")
    assert sheet.startswith('"Gene","Annotation"') and sheet.count("\r\n") == 10 and '"A-c1-ga","B-c1-ga","C-c1-ga"' in sheet
    assert [r.cluster for r in tables.matrix_csv(spark, str(made / "out/gene_presence_absence.csv")).filter("gene_id = 'C-c1-new'").collect()] == ["new"]
    assert text(made / "out/representative_clusters_prot.fasta").count(">") == 9


def test_core_alignment(spark, made):
    core = gzip.decompress((made / "out/core_gene_alignment.aln.gz").read_bytes()).decode().split(">")[1:]
    rows = {r.split("\n")[0]: r.split("\n")[1] for r in core}
    assert set(rows) == {"A", "B", "C"} and len({len(x) for x in rows.values()}) == 1
    c = Collection.load(spark, str(made / "out/collection"))
    done = align(c, Options(alignment="nucleotide"))
    assert {r.gene_id: r.aligned.replace("-", "") for r in done["nucleotide"].collect()} == {r.gene_id: r.nt for r in c.gene_seq.collect() if r.gene_id not in ("A-c1-gh", "C-c1-new")}


def test_add(spark, made):
    cli.main(["add", "-g", str(made / "D.gff"), "-c", str(made / "out")], spark)
    c = Collection.load(spark, str(made / "out/collection"))
    assert sample_names(c) == ["A", "B", "C", "D"]
    got = {r.name: sorted(x.split("-")[0] for x in r.gene_ids) for r in c.families.collect()}
    assert got == {"ga": ["A", "B", "C"], "gb": ["A", "B", "C"], **{f"g{x}": ["A", "B", "C", "D"] for x in "cdef"}, "gg": ["A", "C", "D"], "gh": ["A", "D"], "new": ["C"], "late": ["D"]}


def test_streaming_adds_what_arrives(spark, made, tmp_path):
    from genoloom.streaming.samples import into_collection

    run = into_collection(spark, str(tmp_path / "c"))
    batch = lambda *s: spark.createDataFrame([(str(made / f"{x}.gff"),) for x in s], "gff_file string")
    run(batch("A", "B"), 0)
    run(batch("C"), 1)
    run(batch("C"), 1)  # again
    assert sample_names(Collection.load(spark, str(tmp_path / "c"))) == ["A", "B", "C"]


def test_streaming_waits_for_two_samples(spark, made, tmp_path):
    from genoloom import storage
    from genoloom.streaming.samples import into_collection

    at = str(tmp_path / "c")
    run = into_collection(spark, at)
    batch = lambda *s: spark.createDataFrame([(str(made / f"{x}.gff"),) for x in s], "gff_file string")
    run(batch("A"), 0)
    run(batch("A"), 0)  # again
    assert storage.latest(spark, at) is None
    run(batch("B"), 1)
    assert sample_names(Collection.load(spark, at)) == ["A", "B"]


def test_a_save_that_ends_half_way_leaves_the_version_before(spark, made, tmp_path, monkeypatch):
    from genoloom import storage

    c, at = Collection.load(spark, str(made / "out/collection")), str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        Collection.load(spark, at)
    c.save(at)
    version = storage.latest(spark, at)
    monkeypatch.setattr(storage, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        c.save(at)
    (tmp_path / "c/notes/000000000009-half").mkdir()  # a note without its mark
    assert storage.latest(spark, at) == version and sample_names(Collection.load(spark, at)) == sample_names(c)


def test_two_writers_of_one_version_conflict(spark, tmp_path, monkeypatch):
    """Both look before either writes: one is published, the other is told."""
    at = str(tmp_path / "c")
    assert storage.publish(spark, at, "first", 0) == 1
    look = storage._notes
    seen = look(spark, at)
    monkeypatch.setattr(storage, "_notes", lambda *a: seen)
    assert storage.publish(spark, at, "b-second-writer", 1) == 2
    with pytest.raises(storage.Conflict):
        storage.publish(spark, at, "z-third-writer", 1)
    monkeypatch.undo()
    assert storage.current(spark, at) == (2, "b-second-writer")
    with pytest.raises(storage.Conflict):
        storage.publish(spark, at, "late", 1)
    (tmp_path / "c/notes/000000000003").write_text("half a no")
    assert storage.current(spark, at) == (2, "b-second-writer") and storage.publish(spark, at, "after", 2) == 4 and storage.latest(spark, at) == "after"
    monkeypatch.setattr(storage, "_notes", lambda *a, calls=[]: (calls.append(1), (2, {1: "first", 2: "b"}) if len(calls) == 1 else look(*a))[1])  # noqa: B006
    assert storage.publish(spark, at, "whatever comes") == 5


def test_versions_share_parts(spark, made, tmp_path):
    """Each addition writes its own rows; what no version needs goes."""
    import json
    import os

    out, c = str(tmp_path / "c"), Collection.load(spark, str(made / "out/collection"))
    c.save(out)
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(out) for f in names if "gene_seq" in d and f.endswith(".parquet"))
    first, rows = size(), spark.read.parquet(str(made / "out/collection/") + "/" + json.loads(storage.latest(spark, str(made / "out/collection")))["parts"]["gene_seq"][0])
    for k in range(3):
        c = Collection.load(spark, out)
        few = rows.limit(1).withColumn("gene_id", F.lit(f"new{k}"))
        replace(c, gene_seq=c.gene_seq.unionByName(few), fresh={"gene_seq": few}).save(out)
    now = Collection.load(spark, out)
    assert len(now.parts["gene_seq"]) == 4 and now.gene_seq.count() == c.gene_seq.count() + 1 and size() < 2.5 * first
    with pytest.raises(storage.Conflict):
        c.save(out)
    before = sorted(map(str, now.gene_seq.collect()))
    Collection.clean(spark, out)
    now = Collection.load(spark, out)
    assert sorted(map(str, now.gene_seq.collect())) == before and now.families.count() == c.families.count()
    kept = {x.split("/")[0] for own in now.parts.values() for x in own}
    assert {d for d in os.listdir(out) if d != "notes"} == kept and [n for n in os.listdir(out + "/notes") if n.isdigit()] == ["000000000004"]


def test_exports(spark, made, tmp_path):
    import json

    out, c = tmp_path, Collection.load(spark, str(made / "out/collection"))
    write_outputs(c, str(out), Options(alignment="protein"))
    lines = lambda name: text(out / name).splitlines()
    seqs = {r.gene_id: r for r in c.gene_seq.collect()}
    heads = [x[1:] for x in lines("pan_genome_reference.fna") if x.startswith(">")]
    order = {g: r.seq_ord for g, r in seqs.items()}
    assert heads == sorted(heads, key=order.get) and set(heads) == {r.representative for r in c.families.collect() if len(r.gene_ids) > 1}
    reps = [x[1:].split(" ", 1)[1].split(",")[0] for x in lines("representative_clusters_nucl.fasta") if x.startswith(">")]
    assert reps == sorted(reps, key=order.get)
    assert json.loads(text(out / "samples.json"))[0]["id"] == "A" and len(json.loads(text(out / "samples.json"))) == c.samples.count()
    doc = json.loads(text(out / "annotated_clusters.json"))
    assert {k: v["gene_id"] for k, v in doc.items()} == {r.name: list(r.gene_ids) for r in c.families.collect()}
    assert set(json.loads(text(out / "clusters.json"))) == {r.rep_id for r in c.dedup.collect()}
    assert lines("gene_annotation.csv")[0].startswith("gene_id,sample_id") and len(lines("gene_annotation.csv")) == 1 + c.gene_annotation.count()
    assert lines("gene_position.csv")[0].startswith("A,c1,A-c1-ga,")
    assert sorted(str(f.relative_to(out)) for f in (out / "samples").rglob("*.f*")) == sorted(f"samples/{x}/{x}.{k}" for x in sample_names(c) for k in ("faa", "fna"))
    assert [x[1:] for x in text(out / "samples/A/A.faa").splitlines() if x.startswith(">")] == sorted((g for g, r in seqs.items() if r.sample_id == "A"), key=order.get)
    assert sorted(f.name for f in (out / "clusters/ga").iterdir()) == ["ga.faa", "ga.faa.aln", "ga.fna", "ga.fna.aln"] and text(out / "clusters/ga/ga.fna").count(">") == 3
    rows = [x for x in text(out / "clusters/ga/ga.faa.aln").splitlines() if not x.startswith(">")]
    assert len({len(x) for x in rows}) == 1 and [x.replace("-", "") for x in rows] == [x for x in text(out / "clusters/ga/ga.faa").splitlines() if not x.startswith(">")]
    assert not [f for f in out.rglob("*") if f.name.startswith(("_writing", "part-")) and "alignment_tables" not in str(f)]


def test_saved_alignments_hold_for_unchanged_families(spark, made):
    from genoloom.plans import pipeline

    c = Collection.load(spark, str(made / "out/collection"))
    o = Options(alignment="protein")
    first = align(c, o)["protein"]
    marked = first.withColumn("aligned", pipeline.F.concat(pipeline.F.lit("#"), "aligned")).filter("family <> 'ga'")
    again = align(c, o, {"protein": marked.unionByName(first.filter("family = 'ga' and gene_id <> 'A-c1-ga'"))})["protein"]
    assert {r.family for r in again.collect() if not r.aligned.startswith("#")} == {"ga"}
    assert again.count() == first.count()


def test_numeric_export_refuses_genes_of_no_family(spark):
    a = spark.createDataFrame([(0, "s-c-1", "s", "+"), (1, "s-c-2", "s", "-")], "ann_ord long, gene_id string, sample_id string, strand string")
    places = spark.createDataFrame([("s", "c", 0, "s-c-1"), ("s", "c", 1, "s-c-2")], "sample_id string, seq_id string, pos int, gene_id string")
    samples = spark.createDataFrame([(0, "s")], "sample_ord long, sample_id string")
    whole = spark.createDataFrame([("f", ["s-c-1", "s-c-2"])], "name string, gene_ids array<string>")
    assert sorted((r.gene, r.sample_no, r.cluster_no) for r in gfftools.numeric_export(a, places, whole, samples)[1].collect()) == [("s-c-1@1", 0, 0), ("s-c-2@-1", 0, 0)]
    part = spark.createDataFrame([("f", ["s-c-1"])], "name string, gene_ids array<string>")
    with pytest.raises(Exception, match="no family or sample of s-c-2"):
        gfftools.numeric_export(a, places, part, samples)[1].collect()


def test_large_pairs_are_aligned_in_turn(monkeypatch):
    rows = [(b"MKTAYIAKQR" * k, b"MKTAIAKQR" * k) for k in (1, 3, 2, 5)]
    whole = alignment.aligned(rows)
    monkeypatch.setattr(alignment, "CELLS", 1000)
    assert alignment.aligned(rows) == whole


def test_alignment_paths():
    (score, path), = alignment.aligned([(b"MKTAYIAKQR", b"MKTAIAKQR")], local=False)
    assert [(i, j) for i, j in path if i < 0 or j < 0] == [(4, -1)] and len(path) == 10
    assert score == sum(alignment.SCORES[a, a] for a in b"MKTAIAKQR") - 12
    assert alignment.aligned([(b"AAAA", b"WWWW"), (b"WW", b"WW")])[0] == (0, [])



def test_gff_tools(spark):
    t = spark.createDataFrame([("s", 0, "c-1", "gene", 1, 9, "ID=g;x=1"), ("s", 1, "c-1", "CDS", 1, 9, "ID=k;Parent=g;y=2"), ("s", 2, "c-1", "CDS", 10, 19, "ID=m")], "sample_id string, line_no int, seqid string, type string, start int, end int, attrs string")
    assert [r.attrs for r in gfftools.normalised(t).orderBy("line_no").collect()] == ["ID=s-c_1-1-g", "ID=s-c_1-1-k;Parent=s-c_1-1-g;y=2", "ID=s-c_1-2-m"]
    assert [r.attrs for r in gfftools.renumbered(t).orderBy("line_no").collect()] == ["ID=g;x=1", "ID=s_00001;Parent=g;y=2", "ID=s_00002"]
    t = spark.createDataFrame([("s", n, "c", "CDS", 1, 9, x) for n, x in enumerate(["x=1;ID=a;ID=b;y=2", "x=1", "ID=;x=1"])], t.schema)
    assert [r.attrs for r in gfftools.renumbered(t).orderBy("line_no").collect()] == ["x=1;ID=s_00001;ID=b;y=2", "x=1;ID=s_00002", "ID=;x=1;ID=s_00003"]
    v = spark.createDataFrame([("a", False, "1\t2\t3\t4\t5\t6\t7\t8"), ("a", True, ">x"), ("a", True, "ACGN"), ("b", True, "ACGX")], "file string, in_fasta boolean, line string")
    assert {r.file: r.valid for r in gfftools.valid(v).collect()} == {"a": True, "b": False}


def test_foreign_tables(spark, tmp_path):
    (tmp_path / "x.clstr").write_text(">Cluster 0\n0\t50aa, >1... *\n1\t50aa, >2... at 99%\n>Cluster 1\n0\t40aa, >3... *\n")
    ids = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "aa_id long, gene_id string")
    assert sorted((r.rep_id, r.member_id) for r in tables.clusters_clstr(spark, str(tmp_path / "x.clstr"), ids).filter("member_id is not null").collect()) == [("a", "b")]
    (tmp_path / "pos.csv").write_text("s,c,g1,g2\nt,d,h1\n")
    assert [(r.pos, r.gene_id) for r in tables.positions_csv(spark, str(tmp_path / "pos.csv")).collect()] == [(0, "g1"), (1, "g2"), (0, "h1")]
    (tmp_path / "mcl").write_text("a\tb\nc\n")
    assert tables.clusters_lines(spark, str(tmp_path / "mcl")).count() == 3
