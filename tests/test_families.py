import random
import re

import pytest
from pyspark.sql import functions as F

from genoloom import storage
from genoloom.operators import annotate, families, graphs, hits, paralogs, report, similarity


def members(spark, groups):
    return spark.createDataFrame([(c, o, g) for c, gs in enumerate(groups) for o, g in enumerate(gs)], "cluster_idx long, member_ord long, gene_id string")


def grouped(df):
    out = {}
    for r in df.orderBy("cluster_idx", "member_ord").collect():
        out.setdefault(r.cluster_idx, []).append(r.gene_id)
    return [out[k] for k in sorted(out)]


def test_hit_filter_is_strict(spark):
    row = ("q", "s", 70.0, 80, 100, 80)
    t = spark.createDataFrame([row, ("q", "t", 70.1, 80, 100, 80), ("q", "u", 90.0, 80, 100, 70), ("q", "v", 90.0, 80, 100, 71)], "qseqid string, sseqid string, pident double, length int, qlen int, slen int")
    assert sorted(r.sseqid for r in hits.filtered(t).collect()) == ["t", "v"]


def test_reinflation(spark):
    d = spark.createDataFrame([("a", "a1", 0), ("a", "a2", 1), ("b", None, None), ("c", "c1", 0), ("d", None, None)], "rep_id string, member_id string, member_ord long")
    mcl = spark.createDataFrame([(0, "b", 0), (0, "a", 1)], "mcl_ord long, gene_id string, ord int")
    assert grouped(families.reinflated(mcl, d)) == [["b", "a", "a1", "a2"], ["c", "c1"], ["d"]]
    matched = spark.createDataFrame([("a", "n1", 0)], "rep_id string, member_id string, member_ord long")
    new = spark.createDataFrame([("x", "x1", 0), ("y", None, None)], "rep_id string, member_id string, member_ord long")
    got = grouped(families.reinflated_add(mcl, d, matched, new))
    assert got == [["b", "a", "a1", "a2", "n1"], ["c", "c1"], ["d"], ["x", "x1"], ["y"]]
    merged = families.merged_clusters(d, matched, new)
    assert sorted((r.rep_id, r.member_id) for r in merged.filter("member_id is not null").collect()) == [("a", "a1"), ("a", "a2"), ("a", "n1"), ("c", "c1"), ("x", "x1")]


def test_comparison(spark):
    a = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "cluster string, gene_id string")
    b = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c"), ("y", "d")], "cluster string, gene_id string")
    assert families.equal_families(a, b).first().asDict() == {"same": 1, "diff": 1, "total": 2}
    assert {r.cluster: r.same for r in families.kept_families(a, b).collect()} == {"1": True, "2": True}
    assert {r.cluster: r.same for r in families.kept_families(b, a).collect()} == {"x": True, "y": False}


def python_split(groups, order):
    """The rule of the paralog split, one family after the other, rounds as snapshots."""
    where = {}
    for contig in order:
        for i, g in enumerate(contig):
            where.setdefault(g, contig[max(0, i - 5) : i] + contig[i + 1 : i + 6])
    while True:
        index = {g: c for c, gs in enumerate(groups) for g in gs}
        out, changed = [], False
        for gs in groups:
            by = {}
            for g in gs:
                by.setdefault(g.split("-")[0], []).append(g)
            many = [s for s in by if len(by[s]) > 1]
            if not many:
                out.append(gs)
                continue
            changed = True
            ps = by[min(many, key=lambda s: len(by[s]))]
            seen = [{index[n] for n in where.get(p, []) if n in index} for p in ps]
            parts, rest = [[p] for p in ps], []
            for g in gs:
                if g in ps:
                    continue
                near = where.get(g, [])
                scores = [sum(index.get(n) in s for n in near if n in index) / len(near) if near else 0 for s in seen]
                best = max(range(len(ps)), key=lambda i: (scores[i], -i))
                (parts[best] if scores[best] > 0 else rest).append(g)
            out += parts + ([rest] if rest else [])
        groups = out
        if not changed:
            return groups


@pytest.mark.parametrize("seed", range(2))
def test_paralog_split(spark, seed):
    rng = random.Random(seed)
    order = [[f"s{s}-c{c}-{i}" for i in range(rng.randint(1, 12))] for s in range(3) for c in range(2)]
    every = [g for contig in order for g in contig]
    groups = [[] for _ in range(8)]
    for g in every:
        if rng.random() < 0.9:
            groups[rng.randrange(8)].append(g)
    groups = [g for g in groups if g]
    places = spark.createDataFrame([(c[0].split("-")[0], c[0].split("-")[1], i, g) for c in order for i, g in enumerate(c)], "sample_id string, seq_id string, pos int, gene_id string")
    got = grouped(paralogs.split_paralogs(members(spark, groups), places))
    assert got == python_split(groups, order)
    for gs in got:
        assert len({g.split("-")[0] for g in gs}) == len(gs)  # no sample twice
    assert sorted(g for gs in got for g in gs) == sorted(g for gs in groups for g in gs)
    assert grouped(paralogs.split_paralogs(members(spark, groups), places, True)) == groups


def test_annotation(spark):
    a = spark.createDataFrame([(0, "g1", 120, "abc", "p"), (1, "g2", 150, "xyz", ""), (2, "g3", 150, "xyz", "q, r"), (3, "g4", 90, "", ""), (4, "g5", 90, "abc", "p"), (5, "g6", 90, "xyz", "")], "ann_ord long, gene_id string, length int, gene_name string, gene_product string")
    got = annotate.annotated(members(spark, [["g1", "g3"], ["g2"], ["g4"], ["g5"], ["g6"]]), a).orderBy("family_ord").collect()
    assert [r.name for r in got] == ["abc", "xyz", "groups_2", "abc_00001", "xyz_00002"]
    assert [r.product for r in got] == ["p, q, r", "unknown", "unknown", "p", "unknown"]
    assert (got[0].representative, got[0].min_length, got[0].max_length, got[0].mean_length, got[0]["size"]) == ("g3", 120, 150, 135.0, 2)


def test_name_collision_with_a_numbered_name(spark):
    t = spark.createDataFrame([(0, "x_00001"), (1, "x"), (2, "x")], "cluster_idx long, base string")
    with pytest.raises(ValueError):
        annotate.named(t)


def test_numbers_of_names_are_never_shortened(spark):
    """Six digits stay six, as names of families have to differ."""
    t = spark.range(100_003).select(F.col("id").alias("cluster_idx"), F.lit("x").alias("base"))
    got = annotate.named(t).agg(F.count_distinct("name"), F.max_by("name", "cluster_idx"), F.min_by("name", "cluster_idx")).first()
    assert tuple(got) == (100_003, "x_100002", "x")


def test_classes_at_their_edges(spark):
    t = spark.createDataFrame([("a", 100), ("b", 99), ("c", 98), ("d", 95), ("e", 94), ("f", 15), ("g", 14)], "family string, n_isolates long")
    assert {r["class"]: r.n for r in report.summary(t, 100).collect()} == {"core": 2, "soft_core": 2, "shell": 2, "cloud": 1, "total": 7}
    assert {r["class"]: r.n for r in report.summary(t.limit(0), 3).collect()}["total"] == 0
    with pytest.raises(ValueError):
        report.summary(t, 0)


def test_near_identity_is_greedy(spark):
    rng = random.Random(1)
    from genome import protein

    base = protein(rng, 200)
    change = lambda p, at: p[:at] + ("A" if p[at] != "A" else "C") + p[at + 1 :]
    near, far = change(base, 50), base
    for i in range(12):
        far = change(far, 10 + 15 * i)
    rows = [(0, "a", base), (1, "b", near), (2, "c", far), (3, "d", base), (4, "e", protein(rng, 100))]
    got = similarity.near_identical(spark.createDataFrame(rows, "seq_ord long, gene_id string, aa string"))
    assert sorted((r.rep_id, r.member_id or "") for r in got.collect()) == [("a", "b"), ("a", "d"), ("c", ""), ("e", "")]


def test_search(spark):
    rng = random.Random(2)
    from genome import mutated, protein

    p = protein(rng, 150)
    t = spark.createDataFrame([("a", p), ("b", mutated(rng, p, 0.1)), ("c", protein(rng, 150))], "gene_id string, aa string")
    got = {(r.qseqid, r.sseqid): r for r in similarity.search(t, t).collect()}
    assert set(got) == {("a", "a"), ("b", "b"), ("c", "c"), ("a", "b"), ("b", "a")}
    assert got["a", "a"].pident == 100.0 and got["a", "a"].length == 150 and got["a", "a"].evalue < 1e-60
    assert 80 < got["a", "b"].pident < 97 and got["a", "b"].bitscore == got["b", "a"].bitscore


@pytest.mark.parametrize("small", [1500, 2])
def test_markov_clusters(spark, small):
    e = [("a", "b", 9.0), ("b", "c", 9.0), ("a", "c", 9.0), ("c", "d", 0.5), ("d", "e", 9.0), ("e", "f", 9.0), ("d", "f", 9.0), ("x", "y", 1.0), ("z", "z", 3.0)]
    got = graphs.markov_clusters(spark.createDataFrame(e, "a string, b string, w double"), small=small)
    sets = {}
    for r in got.collect():
        sets.setdefault(r.mcl_ord, set()).add(r.gene_id)
    assert sorted(map(sorted, sets.values())) == [["a", "b", "c"], ["d", "e", "f"], ["x", "y"], ["z"]]


def test_components_of_a_chain(spark):
    e = spark.range(40).select(F.format_string("n%03d", "id").alias("a"), F.format_string("n%03d", F.col("id") + 1).alias("b"))
    assert {r.root for r in graphs.components(e).collect()} == {"n000"}


def test_components_are_those_of_a_walk(spark):
    """Rings, a star whose hub comes last, single nodes, and random links, under names in no order."""
    rng = random.Random(12)
    name = [f"x{k}" for k in rng.sample(range(1000), 150)]
    e = [(k, (k + 1) % 30) for k in range(30)] + [(59, k) for k in range(30, 59)] + [(60, 60), (61, 61)] + [(a, b) for a in range(62, 150) for b in range(62, a) if rng.random() < 0.011]
    near = {k: {k} for ab in e for k in ab}
    for a, b in e:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for k in near:
        seen, todo = {k}, [k]
        while todo:
            todo += (more := near[todo.pop()] - seen)
            seen |= more
        want[name[k]] = min(name[x] for x in seen)
    got = graphs.components(spark.createDataFrame([(name[a], name[b]) for a, b in e], "a string, b string")).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want and len(set(want.values())) > 4


def test_near_identity_of_short_proteins(spark):
    """One residue of 50 to 61 differs, or one differs and another is added: long words in common are not to be had."""
    rng = random.Random(5)
    from genome import protein

    change = lambda p, at: p[:at] + ("A" if p[at] != "A" else "C") + p[at + 1 :]
    rows = []
    for k in range(60):
        p = protein(rng, 50 + k % 12)
        rows += [(2 * k, f"a{k:02}", p), (2 * k + 1, f"b{k:02}", change(p, len(p) // 2))]
    t = spark.createDataFrame(rows, "seq_ord long, gene_id string, aa string")
    assert sorted((r.rep_id, r.member_id) for r in similarity.near_identical(t).collect()) == [(f"a{k:02}", f"b{k:02}") for k in range(60)]
    members, rest = similarity.matched_to(t.filter("seq_ord % 2 = 1"), t.filter("seq_ord % 2 = 0"))
    assert members.count() == 60 and rest.count() == 0
    assert similarity.shared_run(0.98, 0.98) == 13


def graphs_of(seed):
    """Random graphs, and symmetric ones: rings, stars, chains, cliques with a bridge, grids, with equal weights."""
    rng, out = random.Random(seed), []

    def put(name, edges):
        out.extend((f"{name}{a:02}", f"{name}{b:02}", float(w)) for a, b, w in edges)

    for k in range(12):
        n = rng.randint(3, 14)
        put(f"r{k:02}-", [(a, b, rng.choice([1, 2, 2, 5, 0.3])) for a in range(n) for b in range(a) if rng.random() < 0.4])
    for n in (3, 4, 6, 9):
        put(f"ring{n}-", [(a, (a + 1) % n, 1) for a in range(n)])
        put(f"star{n}-", [(0, a, 1) for a in range(1, n)])
        put(f"chain{n}-", [(a, a + 1, 1) for a in range(n - 1)])
        put(f"pair{n}-", [(a + o, b + o, 1) for o in (0, n) for a in range(n) for b in range(a)] + [(0, n, 1)])
        put(f"bip{n}-", [(a, b + n, 1) for a in range(n) for b in range(n)])
    put("grid-", [(5 * x + y, 5 * x + y + d, 1) for x in range(4) for y in range(5) for d in (1, 5) if (d == 5 and x < 3) or (d == 1 and y < 4)])
    return out


def test_clusters_do_not_depend_on_the_size_of_tables(spark):
    e = graphs_of(4)
    e += [(b, a, w / 2) for a, b, w in e[::3]] + e[::5]  # the other way round, lighter, and again
    t = spark.createDataFrame(e, "a string, b string, w double")
    small, large = ({r.gene_id: r.mcl_ord for r in graphs.markov_clusters(t, small=k).collect()} for k in (1500, 0))
    assert small == large and len(set(small.values())) > 25


def test_near_identity_finds_all_pairs(spark):
    """Every pair of proteins of 40 to 120 residues that is as alike has a seed in common: brute force over all pairs."""
    from genome import protein

    from genoloom.functions.alignment import aligned

    rng, rows = random.Random(9), []
    for n in range(40, 121, 2):
        p = protein(rng, n)
        for _ in range(3):
            x = list(p)
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice([[rng.choice("ARNDCQEG")], [], [x[at], "W"]])
            rows.append((len(rows), f"g{len(rows):03}", "".join(x)))
    want = set()
    for i, (_, _, x) in enumerate(rows):
        for j in range(i):
            y = rows[j][2]
            if min(len(x), len(y)) >= 0.98 * max(len(x), len(y)) and abs(len(x) - len(y)) < 4:
                (_, path), = aligned([(x.encode(), y.encode())])
                if sum(a >= 0 and b >= 0 and x[a] == y[b] for a, b in path) >= 0.98 * min(len(x), len(y)):
                    want.add((j, i))
    t = spark.createDataFrame(rows, "seq_ord long, gene_id string, aa string").withColumn("ord", F.col("seq_ord"))
    found = {(r.a, r.b) for r in similarity._identities(similarity._candidates(t, t, 0.98, 0.98, True)).filter("identity >= 0.98").collect()}
    assert len(want) > 40 and found == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_only_touched_components_flow_again(spark, seed, monkeypatch):
    """Random edges in two lots: the clusters are those of all edges at once, and the flow sees none of the components that no new edge touches."""
    rng = random.Random(seed)
    edges = {}
    for _ in range(220):
        block = rng.randrange(25)
        a, b = sorted(rng.sample(range(8), 2)) if rng.random() < 0.95 else (0, 0)
        edges[f"n{block:02}{a}", f"n{block:02}{b}" if rng.random() < 0.97 else f"n{(block + 1) % 25:02}{b}"] = rng.choice([1.0, 2.0, 5.0])
    rows = [(*sorted(k), w) for k, w in edges.items()]
    late = [r for r in rows if r[0] < "n06"][::2] + [("n200", "new", 3.0), ("new2", "new3", 1.0)]
    early = [r for r in rows if r not in late]
    frame = lambda t: spark.createDataFrame(t, "a string, b string, w double")
    saved = graphs.flowed(frame(early))
    flows, flowed = [], graphs.flowed
    monkeypatch.setattr(graphs, "flowed", lambda e, **how: flows.append(e) or flowed(e, **how))
    got = sorted(map(tuple, graphs.reflowed(saved, frame(early), frame(late)).collect()))
    monkeypatch.undo()
    assert got == sorted(map(tuple, graphs.flowed(frame(early + late)).collect()))
    seen = {r.a for r in flows[0].collect()} | {r.b for r in flows[0].collect()}
    ends, root = {x for r in late for x in r[:2]}, {r.gene_id: r.root for r in saved.collect()}
    touched = {root[x] for x in ends if x in root}
    assert seen <= ends | {x for x, r in root.items() if r in touched} and len(seen) < len(root)
    assert sorted((r.mcl_ord, r.gene_id) for r in graphs.ordered(graphs.flowed(frame(rows))).collect()) == sorted((r.mcl_ord, r.gene_id) for r in graphs.markov_clusters(frame(rows)).collect())


def test_a_flow_that_does_not_settle_is_told(spark, monkeypatch):
    monkeypatch.setattr(graphs, "ROUNDS", 1)
    e = [("a", "b", 9.0), ("b", "c", 9.0), ("a", "c", 9.0), ("c", "d", 0.5), ("d", "e", 9.0)]
    with pytest.warns(UserWarning, match="hasn't settled"):
        got = graphs.markov_clusters(spark.createDataFrame(e, "a string, b string, w double"), small=2)
    assert sorted(r.gene_id for r in got.collect()) == ["a", "b", "c", "d", "e"]


def test_candidates_never_go_through_the_driver(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=80)) for _ in range(6)]
    t = spark.createDataFrame([(i, f"g{i}", x) for i, x in enumerate(texts * 2)], "seq_ord long, gene_id string, aa string")
    found, rest = similarity.matched_to(t.filter("seq_ord >= 6"), t.filter("seq_ord < 6"))
    assert sorted((r.rep_id, r.member_id) for r in found.collect()) == sorted((f"g{i}", f"g{i + 6}") for i in range(6))
    own = storage.checkpoint(t.withColumn("ord", F.col("seq_ord")))
    for plan in (found, rest, similarity._candidates(own, own, 0.98, 0.98, True)):
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_sets_of_seeds_meet_as_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SLICE", 3)
    rng = random.Random(9)
    rows = [(i, s) for i in range(30) for s in range(40) if s < 20 or rng.random() < 0.05]  # twenty seeds that all have
    t = spark.createDataFrame(rows, "ord long, seed long")
    pairs = similarity._met(t)
    assert sorted(tuple(r) for r in pairs.collect()) == [(a, b) for a in range(30) for b in range(a + 1, 30)]
    l, r = t.filter("ord < 10 AND seed >= 20"), t.filter("ord >= 10 AND seed >= 20")
    want = {(a, b) for a, s in rows for b, z in rows if a < 10 <= b and s == z >= 20}
    assert sorted(tuple(x) for x in similarity._met(l, r).collect()) == sorted(want)
    # seeds that the same sequences have are pairs once, not once a seed
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 3


def test_families_of_many_paralogs_split_by_counts(spark, monkeypatch):
    monkeypatch.setattr(paralogs, "PARALOGS", 50)
    monkeypatch.setattr(paralogs, "GENES", 90)
    rng = random.Random(3)
    genes = [f"{rng.choice('aabbbccc')}-c-{i}" for i in range(600)]
    rows = [(rng.randrange(3) if i % 2 else 3 + rng.randrange(20), i, g) for i, g in enumerate(genes)]
    t = spark.createDataFrame(rows, "cluster_idx long, member_ord long, gene_id string")
    around = spark.createDataFrame([(g, [rng.choice(genes) for _ in range(rng.randrange(1, 13))]) for g in genes], "gene_id string, neighbours array<string>")
    got = [sorted(tuple(r) for r in paralogs.split_round(t, around, few)[0].collect()) for few in (0, 10, 10**6)]
    assert got[0] == got[1] == got[2]
    assert len({r[1] for r in got[0]}) > 25
    # no rows for genes times paralogs: a row for each gene and block of paralogs
    others = spark.createDataFrame([(0, f"g{i}", 10, 7) for i in range(50)], "cluster_idx long, gene_id string, all int, c long")
    seen = spark.createDataFrame([(0, p, 7) for p in range(200)], "cluster_idx long, paralog int, c long")
    assert [(r.paralog, r.score) for r in paralogs._counted(others, seen, seen.groupBy("cluster_idx").agg(F.count("*").alias("n"))).collect()] .count((0, 0.1)) == 50


def test_clusters_never_go_through_the_driver(spark):
    rows = [(f"n{6 * i + j}", f"n{6 * i + k}", 1.0) for i in range(5) for j in range(6) for k in range(j, 6)]
    frame = lambda r: spark.createDataFrame(r, "a string, b string, w double")
    saved, late = graphs.flowed(frame(rows)), frame([("n0", "n6", 0.01)])
    once, again = graphs.ordered(saved), graphs.ordered(graphs.reflowed(saved, frame(rows), late))
    for got in (once, again):
        assert sorted((r.mcl_ord, r.gene_id) for r in got.collect()) == sorted((o, f"n{6 * i + j}") for o, i in enumerate(sorted(range(5), key=lambda i: min(f"n{6 * i + j}" for j in range(6)))) for j in range(6))
        joins = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x]
        assert all("[_p#" in x for x in joins), joins  # a row a partition, where clusters are numbered


@pytest.mark.parametrize("name", ["markov_clusters", "clusters_after_addition"])
def test_no_round_of_the_clusters_goes_through_the_driver(spark, tmp_path, name):
    """Every job that the query runs, its rounds too: only starts of numbers, a row a partition, are broadcast."""
    from genoloom.queries import QUERIES

    spark.range(150).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    got = QUERIES[name](spark, str(tmp_path)).groupBy("mcl_ord").count().collect()
    assert sorted(tuple(r) for r in got) == [(i, 6) for i in range(25)]
    bus.waitUntilEmpty()
    ran = [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    plans = [r.physicalPlanDescription() for r in ran if r.executionId() not in before]
    sent = [x for p in plans for x in re.findall(r"BroadcastExchange *\nInput \[\d+\]: \[(.*?)#", p)]
    assert len(plans) > 5 and sum("SortMergeJoin" in p for p in plans) > 5
    assert sent and set(sent) == {"_p"}


def test_every_six_customers_are_linked_to_the_next(spark, tmp_path, monkeypatch):
    """The links of markov_clusters make one chain, without a gap, and its parts are those of the whole once pruning has cut it."""
    from genoloom.queries import _linked

    spark.range(150).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    e = storage.checkpoint(_linked(spark, str(tmp_path)).drop("k"))
    links = {(int(r.a[1:]), int(r.b[1:])): r.w for r in e.collect()}
    want = {(k, l): 1.0 for k in range(150) for l in range(k, k // 6 * 6 + 6)} | {(k, k - 1): 0.01 for k in range(6, 150, 6)}
    assert links == want
    assert {r.root for r in graphs.components(e).collect()} == {"n0"}
    tasks, begun = graphs._in_tasks, []
    monkeypatch.setattr(graphs, "_in_tasks", lambda rows, inflation, prune, rounds, b: begun.append((b, rows.count())) or tasks(rows, inflation, prune, rounds, b))
    got = {r.gene_id: (r.root, r.cluster) for r in graphs.flowed(e, small=20).collect()}
    assert got == {f"n{k}": ("n0", min(f"n{x}" for x in range(k // 6 * 6, k // 6 * 6 + 6))) for k in range(150)}
    assert [b for b, _ in begun] == [False, True] and begun[0][1] == 0 and begun[1][1] == 900


def test_matrices_of_many_sizes_are_those_of_each(monkeypatch):
    """Graphs in one table, in whatever batches, and stacks of a few cells."""
    import pandas as pd

    rows = [(a.split("-")[0], *sorted((a, b)), w) for a, b, w in graphs_of(7)]
    t = pd.DataFrame(sorted(rows), columns=["root", "a", "b", "w"]).drop_duplicates(["a", "b"])
    run = lambda tables: sorted(map(tuple, pd.concat(graphs._matrices(1.5, 1e-5, 300, False)(tables)).to_numpy().tolist()))
    want = run(own for _, own in t.groupby("root"))
    assert run([t]) == want and run(t.iloc[k : k + 7] for k in range(0, len(t), 7)) == want
    monkeypatch.setattr(graphs, "CELLS", 100)
    assert run([t]) == want and all(x[2] for x in want)


def test_words_of_one_file_are_many_tasks(spark):
    """A table that one task wrote is dealt out before its words are hashed, and texts that are hashed as one have the seeds of each alone."""
    rng = random.Random(11)
    texts = ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=n)) for n in [0, 1, 3, 4, 5, 6, 7, 8, 40, 0, 41, 6, 90] * 3]
    t = spark.createDataFrame(list(enumerate(texts)), "ord long, aa string").coalesce(1)
    got = similarity.minimizers(t, 5, 3)
    assert got.rdd.getNumPartitions() == 4
    assert len({r[0] for r in got.select(F.spark_partition_id()).distinct().collect()}) > 1

    seeds = {}
    for r in got.collect():
        seeds.setdefault(r.ord, []).append(r.seed)
    alone = [[int(x) for x in similarity._seeds([x.encode()], 5, 3)[1]] for x in texts]
    assert {o: sorted(s) for o, s in seeds.items()} == {o: s for o, s in enumerate(alone) if s}
    assert all(len(s) == len(set(s)) for s in seeds.values())

    def word_hash(x):
        h = 0
        for c in x.encode():
            h = (h * 0x100000001B3 + c) % 2**64
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        return h ^ h >> 32

    for x, s in zip(texts, alone, strict=True):
        h = [word_hash(x[i : i + 5]) for i in range(max(len(x) - 4, 1))] if x else []
        assert {v % 2**64 for v in s} == {min(h[i : i + 3]) for i in range(max(len(h) - 2, min(1, len(h))))}


def test_pairs_are_aligned_once(spark, monkeypatch):
    """Near-identical pairs are turned, the longer first, without a second alignment of them all."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return storage.checkpoint(df)

    monkeypatch.setattr(similarity, "checkpoint", noted)
    text = "".join(random.Random(2).choices("ACDEFGHIKLMNPQRSTVWY", k=100))
    t = spark.createDataFrame([(0, "g0", text[:60] + text[61:]), (1, "g1", text), (2, "g2", text[:-1] + "W")], "seq_ord long, gene_id string, aa string")
    got = similarity.near_identical(t)
    assert sorted((r.rep_id, r.member_id) for r in got.collect()) == [("g1", "g0"), ("g1", "g2")]
    assert max(len([x for x in p.split("\n") if x.lstrip(" :+-*()0123456789").startswith("MapInArrow") and "identity#" in x]) for p in plans) == 1
