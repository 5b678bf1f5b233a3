"""Clustering of the similarity graph by flow: Markov clustering, per connected component."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window, functions as F

from genoloom.storage import checkpoint, drop

INFLATION, PRUNE, SMALL = 1.5, 1e-5, 1500
#: A flow has settled when no weight moves by more; its most rounds; weights this near, many times what still moves, are equal.
SETTLED, ROUNDS, EQUAL = 1e-8, 300, 1e-5
WEIGHTS = ("bitscore", "evalue", "ratio")
#: Cells of a stack of matrices that flow at once.
CELLS = 1 << 20


def edges_of(hits: DataFrame, weight: str = "bitscore") -> DataFrame:
    """(a, b, w), undirected, the heaviest hit of a pair; ``ratio`` is the bit score over the smaller of the two self scores."""
    if weight == "evalue":
        w = F.least(F.lit(200.0), -F.log10(F.greatest("evalue", F.lit(1e-200))))
    elif weight in ("bitscore", "ratio"):
        w = F.col("bitscore")
    else:
        raise ValueError(f"weight: one of {WEIGHTS}")
    t = hits.select(F.least("qseqid", "sseqid").alias("a"), F.greatest("qseqid", "sseqid").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    if weight == "ratio":
        own = t.filter("a = b").select(F.col("a").alias("n"), F.col("w").alias("own"))
        t = t.join(own.withColumnsRenamed({"n": "a", "own": "oa"}), "a", "left").join(own.withColumnsRenamed({"n": "b", "own": "ob"}), "b", "left")
        t = t.select("a", "b", (F.col("w") / F.coalesce(F.least("oa", "ob"), F.col("w"))).alias("w"))
    return t


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node that a node can reach. In each round a node goes to that around it which a hash puts first, and on to where
    that one goes; what has gone to one node is a node of the next round's graph, so that graphs shrink by more than half whatever their shape."""
    first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    e = checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(first("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", first("a"))["n"].alias("to"))
        # low is the least node of the edges among those that have become this one
        low = steps[-1].groupBy(F.col("to").alias("node")).agg(F.min("low").alias("low")) if steps else None
        near = checkpoint(near.join(low, "node") if steps else near.withColumn("low", F.col("node")))
        steps.append(checkpoint(near.join(near.select(F.col("node").alias("to"), F.col("to").alias("on")), "to").select("node", F.col("on").alias("to"), "low")))
        to = steps[-1].select("node", "to")
        new = e.filter("a <> b").join(to.withColumnsRenamed({"node": "a", "to": "u"}), "a").join(to.withColumnsRenamed({"node": "b", "to": "v"}), "b").filter("u <> v")
        last, e = e, checkpoint(new.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
        drop(last, near)
        if e.isEmpty():
            break
    found = None
    for step in reversed(steps):
        up = step.groupBy("to").agg(F.min("low").alias("root"))
        if found is not None:
            up = up.join(found.withColumnsRenamed({"node": "to", "root": "on"}), "to", "left").select("to", F.coalesce("on", "root").alias("root"))
        found = step.join(up, "to").select("node", "root")
    found = checkpoint(found)
    drop(e, *steps)
    return found


def _flow(m, inflation: float, prune: float, rounds: int):
    """(matrices, whether each has settled) of a stack of matrices, each of which flows until it has."""
    import numpy as np

    out, settled, live = np.empty_like(m), np.zeros(len(m), bool), np.arange(len(m))
    for _ in range(rounds):
        new = (m @ m) ** inflation
        new /= new.sum(axis=1, keepdims=True)
        new[new < prune] = 0
        new /= new.sum(axis=1, keepdims=True)
        done, m = np.abs(new - m).max(axis=(1, 2)) < SETTLED, new
        if done.any():
            out[live[done]], settled[live[done]] = m[done], True
            live, m = live[~done], m[~done]
        if not len(live):
            break
    out[live] = m
    return out, settled


def _clusters_of(m):
    """Of a stack of matrices the place of each node's cluster, its least: nodes follow the one that draws them most, the least among equals, and
    those that follow each other are a cluster."""
    import numpy as np

    n = m.shape[1]
    base = np.arange(len(m))[:, None] * n
    on = ((m >= m.max(axis=1, keepdims=True) * (1 - EQUAL)).argmax(axis=1) + base).ravel()
    low = np.minimum(np.arange(len(on)), on)
    for _ in range(n.bit_length()):  # twice as far each time, till all are where nodes follow each other in a ring
        low, on = np.minimum(low, low[on]), on[on]
    ring, least = low[on], np.full(len(on), len(on))
    np.minimum.at(least, ring, np.arange(len(on)))
    return least[ring].reshape(len(m), n) - base


def _matrices(inflation: float, prune: float, rounds: int, begun: bool):
    """For tables of (root, a, b, w), sorted by root: (cluster, gene_id, settled). Graphs of one size are a stack of dense matrices. Rows are edges, or, once the
    flow has ``begun``, the weights of a matrix, a column a b."""

    def whole(pdf):
        import numpy as np
        import pandas as pd

        code, names = pd.factorize(np.concatenate([pdf.a.to_numpy(), pdf.b.to_numpy()]), sort=True)
        graph = pd.factorize(pdf.root)[0]
        of = np.empty(len(names), np.int64)
        of[code] = np.concatenate([graph, graph])
        by = np.lexsort((np.arange(len(names)), of))
        size = np.bincount(of)
        start = np.cumsum(size) - size
        place = np.empty(len(names), np.int64)
        place[by] = np.arange(len(names)) - start[of[by]]
        i, j, w = place[code[: len(pdf)]], place[code[len(pdf) :]], pdf.w.to_numpy()
        for n in np.unique(size).tolist():
            every, most = np.flatnonzero(size == n), max(1, CELLS // (n * n))
            for k in range(0, len(every), most):
                own, rank = every[k : k + most], np.full(len(size), -1)
                rank[own] = np.arange(len(own))
                at = rank[graph]
                on = at >= 0
                m, at, x, y = np.zeros((len(own), n, n)), at[on], i[on], j[on]
                m[at, x, y] = w[on]
                if not begun:
                    m[at, y, x] = w[on]
                    d = np.arange(n)
                    m[:, d, d] = 0
                    m[:, d, d] = np.maximum(m.max(axis=1), 1e-12)
                    m /= m.sum(axis=1, keepdims=True)
                m, settled = _flow(m, inflation, prune, rounds)
                nodes = by[start[own][:, None] + np.arange(n)]
                yield pd.DataFrame({"cluster": names[np.take_along_axis(nodes, _clusters_of(m), 1).ravel()], "gene_id": names[nodes.ravel()], "settled": np.repeat(settled, n)})

    def run(tables):
        import pandas as pd

        held = []
        for t in tables:
            if not len(t):
                continue
            ends = (t.root != t.root.iloc[-1]).to_numpy()
            if ends.any() or (held and held[-1].root.iloc[-1] != t.root.iloc[0]):  # what is before the last graph of the table is whole
                yield from whole(pd.concat([*held, t[ends]]))
                held = []
            held.append(t[~ends])
        if held:
            yield from whole(pd.concat(held))

    return run


def _in_tasks(rows: DataFrame, inflation: float, prune: float, rounds: int, begun: bool) -> DataFrame:
    """(cluster, gene_id, settled) of the graphs (root, a, b, w), each of which is one task's; dealt over all partitions, as they cost more than they weigh."""
    kind = rows.schema["a"].dataType.simpleString()
    rows = rows.select("root", "a", "b", "w").repartition(_parts(rows), "root").sortWithinPartitions("root")
    return rows.mapInPandas(_matrices(inflation, prune, rounds, begun), f"cluster {kind}, gene_id {kind}, settled boolean")


def _parts(t: DataFrame) -> int:
    return int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _beyond(root: DataFrame, small: int) -> DataFrame:
    """(a) of (node, root): nodes whose component has more than ``small``. Such roots are few, and each is dealt out, as the nodes of one are not to be one task's."""
    n = _parts(root)
    large = root.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > small).select("root", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("deal"))
    return checkpoint(root.withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")).join(large.hint("merge"), ["root", "deal"], "left_semi").select(F.col("node").alias("a")))


def _large(edges: DataFrame, inflation: float, prune: float, small: int) -> DataFrame:
    """The same over a sparse matrix (i, j, w), a column a j, as joins and sums; pruning keeps it sparse. Where pruning has cut it, what has no weight in common
    flows on by itself, so after the second, fourth, eighth... round parts of up to ``small`` nodes leave for a task each."""
    t = edges.filter("a <> b")
    t = t.select(F.col("a").alias("i"), F.col("b").alias("j"), "w").unionByName(t.select(F.col("b").alias("i"), F.col("a").alias("j"), "w"))
    column = Window.partitionBy("j")
    share = F.col("w") / F.sum("w").over(column)
    t = t.unionByName(t.groupBy("j").agg(F.max("w").alias("w")).select(F.col("j").alias("i"), "j", "w"))
    last = checkpoint(t.repartition(_parts(t), "j").withColumn("w", share))
    m, found = last, []
    for k in range(1, ROUNDS + 1):
        left = m.select("i", F.col("j").alias("k"), F.col("w").alias("x"))
        right = m.select(F.col("i").alias("k"), "j", F.col("w").alias("y"))
        new = left.join(right, "k").select("i", "j", (F.col("x") * F.col("y")).alias("w"), F.lit(0.0).alias("v"))
        new = new.unionByName(m.select("i", "j", F.lit(0.0).alias("w"), F.col("w").alias("v"))).repartition(_parts(t), "j")  # v is the weight before
        new = new.groupBy("i", "j").agg(F.pow(F.sum("w"), F.lit(inflation)).alias("w"), F.sum("v").alias("v")).withColumn("w", share)
        new = new.withColumn("w", F.when(F.col("w") >= F.least(F.lit(prune), F.max("w").over(column)), F.col("w")).otherwise(0.0)).withColumn("w", share)
        new = checkpoint(new.filter("w > 0 OR v > 0"))
        moved = new.agg(F.max(F.abs(F.col("w") - F.col("v")))).first()[0]
        drop(last)
        last, m = new, new.filter("w > 0").select("i", "j", "w")
        if moved is None or moved < SETTLED:
            break
        if small > 1 and k > 1 and k & (k - 1) == 0:
            root = components(m.select(F.col("i").alias("a"), F.col("j").alias("b")))
            beyond = _beyond(root, small)
            rows = m.withColumnsRenamed({"i": "a", "j": "b"}).join(beyond, "a", "left_anti").join(root.withColumnRenamed("node", "a"), "a")
            found.append(checkpoint(_in_tasks(rows, inflation, prune, ROUNDS - k, True)))
            new = checkpoint(m.join(beyond.withColumnRenamed("a", "i"), "i", "left_semi"))
            drop(last, root, beyond)
            last = m = new
            if m.isEmpty():
                break
    settled = moved is None or moved < SETTLED
    most = m.groupBy("j").agg(F.max("w").alias("most"))
    owner = m.join(most, "j").filter(F.col("w") >= F.col("most") * (1 - EQUAL)).groupBy("j").agg(F.min("i").alias("i")).select(F.col("i").alias("a"), F.col("j").alias("b"))
    out = components(owner).select(F.col("root").alias("cluster"), F.col("node").alias("gene_id"), F.lit(settled).alias("settled"))
    for t in found:
        out = out.unionByName(t)
    return out


def flowed(edges: DataFrame, inflation: float = INFLATION, prune: float = PRUNE, small: int = SMALL) -> DataFrame:
    """(root, cluster, gene_id) of (a, b, w), undirected; of edges between the same nodes the heaviest counts. A node follows the node that
    draws it most, the least among equals, and those that follow each other are a cluster, named by its least node; root is the
    least node of the connected component.

    Components of up to ``small`` nodes are one task's matrix each; larger ones are tables, by the same rule. One whose flow hasn't settled in
    ``ROUNDS`` rounds is told in a warning and clustered by its last state.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    edges = checkpoint(edges.groupBy("a", "b").agg(F.max("w").alias("w")))
    root = components(edges)
    beyond = _beyond(root, small)
    found = _in_tasks(edges.join(beyond, "a", "left_anti").join(root.withColumnRenamed("node", "a"), "a"), inflation, prune, ROUNDS, False)
    if not beyond.isEmpty():
        found = found.unionByName(_large(edges.join(beyond, "a", "left_semi"), inflation, prune, small))
    found = checkpoint(found)
    open_ = found.filter("not settled").groupBy("cluster").count()
    if told := [r[0] for r in open_.orderBy("cluster").limit(5).collect()]:
        warnings.warn(f"{open_.count()} clusters are of components whose flow hasn't settled in {ROUNDS} rounds, such as {', '.join(map(str, told))}", stacklevel=2)
    return found.join(root, found["gene_id"] == root["node"]).select("root", "cluster", "gene_id")


def ordered(found: DataFrame) -> DataFrame:
    """(mcl_ord, gene_id, ord) of (cluster, gene_id): larger clusters first, then by name."""
    from genoloom.operators.families import numbered

    keys = found.groupBy("cluster").agg((-F.count("*")).alias("n")).select(F.struct("n", "cluster").alias("key"))
    index = numbered(keys, ["key"]).select(F.col("cluster_idx").alias("mcl_ord"), F.col("key.cluster").alias("cluster"))
    return found.join(index.hint("merge"), "cluster").select("mcl_ord", "gene_id", (F.row_number().over(Window.partitionBy("mcl_ord").orderBy("gene_id")) - 1).alias("ord"))


def markov_clusters(edges: DataFrame, inflation: float = INFLATION, prune: float = PRUNE, small: int = SMALL) -> DataFrame:
    """(mcl_ord, gene_id, ord): the clusters of ``flowed``, larger ones first."""
    return ordered(flowed(edges, inflation, prune, small))


def reflowed(saved: DataFrame, old_edges: DataFrame, new_edges: DataFrame, **how) -> DataFrame:
    """``flowed`` of old and new edges together, where ``saved`` is ``flowed`` of the old ones: only components that a new edge
    touches flow again, with the old edges inside them; all others stay as saved."""
    ends = new_edges.select(F.col("a").alias("gene_id")).unionByName(new_edges.select(F.col("b").alias("gene_id"))).distinct()
    touched = checkpoint(saved.join(ends.hint("merge"), "gene_id", "left_semi").select("root").distinct())
    inside = saved.join(touched, "root", "left_semi").select(F.col("gene_id").alias("a"))
    again = flowed(old_edges.join(inside.hint("merge"), "a", "left_semi").select("a", "b", "w").unionByName(new_edges.select("a", "b", "w")), **how)
    return saved.join(touched, "root", "left_anti").select("root", "cluster", "gene_id").unionByName(again)
