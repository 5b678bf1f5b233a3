"""Alignments of families and of the core genome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from genoloom.functions.sequences import back_translate
from genoloom.storage import checkpoint


#: Profiles that a task aligns along one tree.
GROUP = 64
#: Bytes of the profiles of the groups that a task aligns side by side.
HELD = 16 << 20
_NODE = "family string, node long, data binary, whole boolean, h1 long, h2 long"


def _sketched(seqs: DataFrame, protein: bool) -> DataFrame:
    """Nodes of the first level: a row for each different sequence (family, node, seq)."""

    def run(batches):
        import pyarrow as pa

        from genoloom.functions import profiles

        k = profiles.kind(protein)[3]
        for b in batches:
            marks = [profiles.sketch(profiles.words(profiles.profile(s), k)) for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.binary()), pa.array([False] * b.num_rows), *(pa.array([m[j] for m in marks], pa.int64()) for j in (0, 1))], names=["family", "node", "data", "whole", "h1", "h2"])

    return seqs.select("family", "node", "seq").mapInArrow(run, _NODE)


def _grouped(nodes: DataFrame) -> DataFrame:
    """Adds group, of at most ``GROUP`` nodes of a family that are near in the order of their sketches. Ranks come from ranges of the
    order and the sizes of the ranges before, so that no family is in one task."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "node"]
    keys = checkpoint(nodes.select("family", *order).repartitionByRange(parts, "family", *order).withColumn("part", F.spark_partition_id()))
    keys = keys.withColumn("at", F.row_number().over(Window.partitionBy("family", "part").orderBy(*order)))
    sizes = keys.groupBy("family", "part").agg(F.count("*").alias("n"))
    before = sizes.select("family", "part", (F.sum("n").over(Window.partitionBy("family").orderBy("part")) - F.col("n")).alias("before"))
    rank = keys.join(before.hint("merge"), ["family", "part"]).select("family", "node", F.floor((F.col("at") + F.col("before") - 1) / GROUP).alias("group"))
    return nodes.join(rank.hint("merge"), ["family", "node"])


def _aligned_groups(nodes: DataFrame, protein: bool) -> DataFrame:
    """Of each group: a row (``up`` null) with its profile, and a row for each of its nodes with the places of its columns in that."""

    names = ["family", "node", "up", "data", "whole", "h1", "h2"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from genoloom.functions import profiles

        def groups():
            """(family, nodes, profiles) of each group, whose rows are one after the other."""
            last, nodes_, own = None, [], []
            for b in batches:
                for family, group, node, data, whole in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                    if (family, group) != last and own:
                        yield last[0], nodes_, own
                        nodes_, own = [], []
                    last = family, group
                    nodes_.append(node)
                    own.append(np.frombuffer(data, np.float32).reshape(-1, profiles.LETTERS) if whole else profiles.profile(data.decode()))
            if own:
                yield last[0], nodes_, own

        def done(held):
            cols = [[] for _ in names]
            for (family, nodes_, own), (one, places) in zip(held, profiles.progressive_all([own for _, _, own in held], protein), strict=True):
                n = len(own)
                h1, h2 = profiles.sketch(profiles.words(one, profiles.kind(protein)[3]))
                rows = [family] * (n + 1), [nodes_[0], *nodes_], [None, *[nodes_[0]] * n], [one.tobytes(), *[p.astype(np.int32).tobytes() for p in places]], [True] * (n + 1), [h1] + [None] * n, [h2] + [None] * n
                for col, row in zip(cols, rows, strict=True):
                    col += row
            types = pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        held, size = [], 0
        for g in groups():
            held.append(g)
            size += sum(p.nbytes for p in g[2])
            if size >= HELD:
                yield done(held)
                held, size = [], 0
        if held:
            yield done(held)

    schema = "family string, node long, up long, data binary, whole boolean, h1 long, h2 long"
    # aligning costs far more than its rows weigh, so that partitions are not to be put together by their size
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("family", "group", "node", "data", "whole").repartition(parts, "family", "group").sortWithinPartitions("family", "group", "node")
    return rows.mapInArrow(run, schema)


def family_alignments(genes: DataFrame, protein: bool = True) -> DataFrame:
    """(family, gene_id, aligned) of (family, gene_id, seq), by progressive alignment.

    Equal sequences of a family are one. Level by level, groups of at most ``GROUP`` near sequences, or profiles of groups, are
    aligned along a tree of their word distances, each group by a task, until a family has one profile. Each level keeps the places of its
    columns in the next, and a gene's row follows from those alone.
    """
    genes = genes.select("family", "gene_id", "seq")
    seqs = checkpoint(genes.select("family", "seq").distinct().withColumn("node", F.monotonically_increasing_id()))
    nodes, levels = checkpoint(_sketched(seqs, protein)), []
    while True:
        several = nodes.groupBy("family").count().filter("count > 1").select("family").hint("merge")
        open_ = nodes.join(several, "family", "left_semi")
        if open_.isEmpty():
            break
        done = checkpoint(_aligned_groups(_grouped(open_), protein))
        levels.append(done.filter("up IS NOT NULL").select("family", F.col("node").alias("at"), "up", F.col("data").alias("to")))
        nodes = done.filter("up IS NULL").select("family", "node", "data", "whole", "h1", "h2").unionByName(nodes.join(several, "family", "left_anti"))
    rows = seqs.select("family", "seq", "node", F.col("node").alias("at"), F.lit(None).cast("binary").alias("places"))
    for level in levels:
        both = rows.join(level.hint("merge"), ["family", "at"], "left")
        rows = checkpoint(both.select("family", "seq", "node", F.coalesce("up", "at").alias("at"), "places", "to").mapInArrow(_composed, "family string, seq string, node long, at long, places binary"))
    # as many columns as a family's last profile has, or its one sequence
    width = F.when(F.col("whole"), F.octet_length("data") / (4 * 27)).otherwise(F.char_length(F.decode("data", "utf-8"))).cast("int")
    laid = rows.join(nodes.select("family", width.alias("width")).hint("merge"), "family").select("family", "seq", "places", "width").mapInArrow(_laid, "family string, seq string, aligned string")
    return genes.join(laid.hint("merge"), ["family", "seq"]).select("family", "gene_id", "aligned")


def _composed(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        out = []
        for own, to in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
            if own and to:
                to = np.frombuffer(to, np.int32)[np.frombuffer(own, np.int32)].tobytes()
            out.append(to if to is not None else own)
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(out, pa.binary())], names=["family", "seq", "node", "at", "places"])


def _laid(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        out = []
        for seq, places, width in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if places is not None:
                row = np.full(width, "-")
                row[np.frombuffer(places, np.int32)] = list(seq)
                seq = "".join(row)
            out.append(seq)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["family", "seq", "aligned"])


def codon_alignments(proteins: DataFrame, nt: DataFrame) -> DataFrame:
    """Protein alignments in codons; a gene without nucleotides is an error."""
    t = proteins.join(nt.select("gene_id", "nt"), "gene_id", "left")
    return t.select("family", "gene_id", F.when(F.col("nt").isNull(), F.raise_error(F.concat(F.lit("no nucleotides of "), F.col("gene_id"))).cast("string")).otherwise(back_translate(F.col("aligned"), F.col("nt"))).alias("aligned"))


def core_alignment(alignments: DataFrame, families: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_ord, sample_id, aligned): the alignments of families with one gene of every sample, one after the other in the
    order of families; every sample has a row. families: family, family_ord."""
    from genoloom.operators.report import single_copy_core

    t = alignments.withColumn("sample_id", F.split("gene_id", "-", 2)[0])
    t = t.join(single_copy_core(t, samples.count()), "family", "left_semi").join(families.select("family", "family_ord"), "family")
    rows = t.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("family_ord", "aligned"))), lambda x: x["aligned"]), "").alias("aligned"))
    return samples.select("sample_ord", "sample_id").join(rows, "sample_id", "left").select("sample_ord", "sample_id", F.coalesce("aligned", F.lit("")).alias("aligned"))


def unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Families whose set of genes is as it was: their saved alignments hold. Both: family, gene_id."""
    sets = lambda t: t.groupBy("family").agg(F.array_sort(F.collect_set("gene_id")).alias("genes"))
    return sets(old).join(sets(new), ["family", "genes"]).select("family")
