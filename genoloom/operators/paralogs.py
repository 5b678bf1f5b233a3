"""Splitting families that hold paralogs by the genes around their members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from genoloom.operators.genes import neighbours
from genoloom.storage import checkpoint

ROUNDS, CEILING = 100_000, 1_000_000
#: Paralogs of a family up to which its genes meet them as rows; genes that a task then compares at a time with the paralogs of a larger one, and
#: how many of these: about as many words of 64 bits fit a core's cache.
FEW, GENES, PARALOGS = 32, 50_000, 1 << 17
_CELLS = 1 << 15


def paralogs(membership: DataFrame) -> DataFrame:
    """cluster_idx, paralog (from 0), gene_id: the genes of the sample that has the fewest of a family's genes but more
    than one; among equals the sample that comes first in the family."""
    t = membership.withColumn("sample_id", F.split("gene_id", "-", 2)[0])
    per = t.groupBy("cluster_idx", "sample_id").agg(F.count("*").alias("n"), F.min("member_ord").alias("first"))
    pick = per.filter((F.col("n") > 1) & (F.col("n") < CEILING)).groupBy("cluster_idx").agg(F.min_by("sample_id", F.struct("n", "first")).alias("sample_id"))
    w = Window.partitionBy("cluster_idx").orderBy("member_ord")
    return t.join(pick, ["cluster_idx", "sample_id"]).select("cluster_idx", (F.row_number().over(w) - 1).alias("paralog"), "gene_id")


def first_neighbours(positions: DataFrame) -> DataFrame:
    """gene_id, neighbours; of a gene that is placed twice, those of its first place."""
    return neighbours(positions).groupBy("gene_id").agg(F.min_by("neighbours", "pos").alias("neighbours"))


def _votes(others: DataFrame, seen: DataFrame) -> DataFrame:
    """(cluster_idx, gene_id, paralog, score) of each gene with each paralog that sees one of its families."""
    # each gene meets all paralogs that see one of its families, so genes are dealt out however small their table is
    parts = int(others.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = others.groupBy("cluster_idx", "gene_id", "c").agg(F.count("*").alias("k"), F.first("all").alias("all")).repartition(parts, "cluster_idx", "gene_id")
    return t.join(seen, ["cluster_idx", "c"]).groupBy("cluster_idx", "gene_id", "paralog").agg((F.sum("k") / F.first("all")).alias("score"))


def _counted(others: DataFrame, seen: DataFrame, many: DataFrame) -> DataFrame:
    """The same of families (cluster_idx, n) of many paralogs, but of each gene only the best of each ``PARALOGS`` of them.

    Genes of a family are dealt out, and meet its paralogs as sets of bits: a bit a paralog, a set a family that it sees. A gene's
    scores are the sums of the sets of its neighbours, in binary planes, so that neither rows nor shuffles grow with genes times paralogs.
    """
    genes = others.join(many, "cluster_idx").groupBy("cluster_idx", "gene_id").agg(F.collect_list("c").alias("cs"), F.first("all").alias("all"), F.first("n").alias("n"))
    shares = many.join(others.select("cluster_idx", "gene_id").distinct().groupBy("cluster_idx").agg(F.count("*").alias("m")), "cluster_idx").select("cluster_idx", F.ceil(F.col("m") / GENES).cast("int").alias("shares"))
    genes = genes.join(shares, "cluster_idx").withColumn("share", F.pmod(F.hash("gene_id"), F.col("shares"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PARALOGS).cast("int"))))
    sets = seen.groupBy("cluster_idx", "paralog").agg(F.collect_list("c").alias("cs")).join(shares, "cluster_idx")
    sets = sets.select("cluster_idx", "paralog", "cs", F.floor(F.col("paralog") / PARALOGS).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    # counting costs far more than its rows weigh, so that partitions are not to be put together by their size
    parts, key = int(others.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["cluster_idx", "share", "block"]
    left = genes.select(*key, "gene_id", "cs", "all").repartition(parts, *key)
    right = sets.select(F.col("cluster_idx").alias("of"), "share", "block", "paralog", "cs").repartition(parts, "of", "share", "block")
    return left.groupBy(*key).cogroup(right.groupBy("of", "share", "block")).applyInArrow(_best_of, f"cluster_idx {others.schema['cluster_idx'].dataType.simpleString()}, gene_id string, paralog int, score double")


def _best_of(genes, sets):
    """Of the genes of a family, the paralog with the greatest score, the first among equals, if any is above zero."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def lists(t):
        col = t["cs"].combine_chunks()
        return pc.list_value_length(col).to_numpy(zero_copy_only=False), col.flatten().to_numpy()

    n, own = lists(genes)
    start = np.cumsum(n) - n
    sets = sets.sort_by("paralog")
    ids, (m, theirs) = sets["paralog"].to_numpy(), lists(sets)
    who = np.repeat(np.arange(len(ids)), m)
    best, top = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    slots = np.arange(n.max(initial=0))
    for low in range(0, len(ids), 4096):  # some paralogs at a time, so that all sets of bits are small
        inside = slice(*np.searchsorted(who, [low, low + 4096]))
        cs, row = np.unique(theirs[inside], return_inverse=True)
        if not len(cs):
            continue
        here = min(4096, len(ids) - low)
        bits = np.zeros((len(cs) + 1, -(-here // 64) * 64), np.uint8)  # the last is of families that none of these sees
        bits[row, who[inside] - low] = 1
        bits = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        at = np.minimum(np.searchsorted(cs, own), len(cs) - 1)
        at = np.where(cs[at] == own, at, len(cs))
        step = max(1, _CELLS // bits.shape[1])
        for k in range(0, len(n), step):
            g = np.arange(k, min(k + step, len(n)))
            planes = []
            for s in slots[: n[g].max()]:
                more = bits[np.where(s < n[g], at[np.minimum(start[g] + s, len(own) - 1)], len(cs))]
                for p, plane in enumerate(planes):
                    planes[p], more = plane ^ more, plane & more
                if s + 1 >= 1 << len(planes):
                    planes.append(more)
            score, left = np.zeros(len(g), np.int64), np.full((len(g), bits.shape[1]), ~np.uint64(0))
            for plane in reversed(planes):
                some = left & plane
                any_ = some.any(axis=1)
                left = np.where(any_[:, None], some, left)
                score = score * 2 + any_
            word = (left != 0).argmax(axis=1)
            bit = left[np.arange(len(g)), word]
            first = word * 64 + np.bitwise_count((bit & (~bit + np.uint64(1))) - np.uint64(1))
            better = score > top[g]
            top[g[better]], best[g[better]] = score[better], ids[low + first[better]]
    has = np.flatnonzero(top)
    found = genes.take(pa.array(has))
    return pa.table({"cluster_idx": found["cluster_idx"], "gene_id": found["gene_id"], "paralog": pa.array(best[has].astype(np.int32)), "score": pa.array(top[has] / found["all"].to_numpy())})


def split_round(membership: DataFrame, around: DataFrame, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(membership after one round, indexes of the families that split). ``around``: gene_id, neighbours."""
    chosen = checkpoint(paralogs(membership))
    where = membership.select(F.col("gene_id").alias("n"), F.col("cluster_idx").alias("c")).distinct()
    touched = membership.join(chosen.select("cluster_idx").distinct(), "cluster_idx", "left_semi")
    near = touched.join(around.hint("merge"), "gene_id").select("cluster_idx", "gene_id", F.size("neighbours").alias("all"), F.explode("neighbours").alias("n"))
    near = checkpoint(near.join(where.hint("merge"), "n").select("cluster_idx", "gene_id", "all", "c"))
    seen = near.join(chosen, ["cluster_idx", "gene_id"]).select("cluster_idx", "paralog", "c").distinct()
    others = near.join(chosen.select("cluster_idx", "gene_id"), ["cluster_idx", "gene_id"], "left_anti")
    many = chosen.groupBy("cluster_idx").agg(F.count("*").alias("n")).filter(F.col("n") > few)
    votes = _votes(others.join(many, "cluster_idx", "left_anti"), seen.join(many, "cluster_idx", "left_anti"))
    votes = votes.unionByName(_counted(others, seen, many))
    best = votes.groupBy("cluster_idx", "gene_id").agg(F.max_by("paralog", F.struct("score", -F.col("paralog"))).alias("paralog"))
    rest = (1 << 31) - 1
    own = chosen.select("cluster_idx", "gene_id", "paralog", F.lit(0).alias("later"))
    goes = own.unionByName(best.select("cluster_idx", "gene_id", "paralog", F.lit(1).alias("later")))
    t = membership.join(chosen.select("cluster_idx", F.lit(True).alias("split")).distinct(), "cluster_idx", "left").join(goes, ["cluster_idx", "gene_id"], "left")
    group = F.when(F.col("split"), F.coalesce("paralog", F.lit(rest))).otherwise(0)
    t = t.select("cluster_idx", group.alias("group"), F.coalesce("later", F.lit(1)).alias("later"), "member_ord", "gene_id", F.coalesce("split", F.lit(False)).alias("split"))
    return t, chosen.select("cluster_idx").distinct()


def split_paralogs(membership: DataFrame, positions: DataFrame, dont_split: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """Rounds until no family has paralogs; a round sees the families as it found them, so it is one step of joins.

    A family is kept by the path of groups that led to it, whose order is the final order of families; families
    that are settled take no part in later rounds but as neighbours.
    """
    if dont_split:
        return membership
    from genoloom.operators.families import numbered

    around = checkpoint(first_neighbours(positions))
    t = checkpoint(membership)
    for _ in range(rounds):
        split, touched = split_round(t, around)
        split = checkpoint(split)
        if split.filter("split").isEmpty():
            break
        keys = split.select(F.struct("cluster_idx", "group").alias("key")).distinct()
        index = numbered(keys, ["key"])
        w = Window.partitionBy("new_idx").orderBy("later", "member_ord", "gene_id")
        t = split.withColumn("key", F.struct("cluster_idx", "group")).join(index.withColumnRenamed("cluster_idx", "new_idx"), "key")
        t = checkpoint(t.select(F.col("new_idx").alias("cluster_idx"), (F.row_number().over(w) - 1).cast("long").alias("member_ord"), "gene_id"))
    return t
