"""Alignment of families by profiles, against the star that each sequence is aligned to by itself, and over many tasks."""

import random

import numpy as np
import pytest
from genome import protein
from pyspark.sql import functions as F

from genoloom.functions import alignment as al, profiles
from genoloom.operators import msa


def changed(rng, p, k):
    """``p`` with ``k`` changes, of which two in five put in or take out up to five residues."""
    p = list(p)
    for _ in range(k):
        i, kind = rng.randrange(len(p)), rng.random()
        if kind < 0.2:
            p[i:i] = rng.choices(al.RESIDUES, k=rng.randrange(1, 6))
        elif kind < 0.4 and len(p) > 8:
            del p[i : i + rng.randrange(1, 6)]
        else:
            p[i] = rng.choice(al.RESIDUES)
    return "".join(p)


def laid(seqs, is_protein=True):
    done, places = profiles.progressive([profiles.profile(s) for s in seqs], is_protein)
    out = []
    for s, to in zip(seqs, places, strict=True):
        row = ["-"] * len(done)
        for c, x in zip(s, to.tolist(), strict=True):
            row[x] = c
        out.append("".join(row))
    return out


def sum_of_pairs(rows):
    total = 0
    for i in range(len(rows)):
        for j in range(i):
            gap = 0
            for x, y in zip(rows[i], rows[j], strict=True):
                if "-" not in (x, y):
                    total, gap = total + int(al.SCORES[ord(x), ord(y)]), 0
                elif (x, y) != ("-", "-"):
                    now = 1 if x == "-" else 2
                    total, gap = total - (1 if gap == now else 12), now
    return total



def star(seqs: list[str]) -> list[str]:
    """Every sequence globally aligned to the longest (the first among equals); gaps of all are merged."""

    centre = max(range(len(seqs)), key=lambda i: (len(seqs[i]), -i))
    c = seqs[centre].encode()
    scores, cost = al.SCORES, (al.OPEN, al.EXTEND)
    others = [i for i in range(len(seqs)) if i != centre]
    paths = {}
    for k in range(0, len(others), 16):
        own = others[k : k + 16]
        for i, (_, path) in zip(own, al.aligned([(c, seqs[i].encode()) for i in own], False, scores, *cost), strict=True):
            paths[i] = path
    room = [0] * (len(c) + 1)  # gaps before each place of the centre
    for path in paths.values():
        at = run = 0
        for i, _ in path:
            run = run + 1 if i < 0 else 0
            at = i + 1 if i >= 0 else at
            if run:
                room[at] = max(room[at], run)
    out = []
    for n, s in enumerate(seqs):
        path = paths.get(n) or [(i, i) for i in range(len(c))]
        row, at, extra = [], 0, []
        for i, j in path:
            if i < 0:
                extra.append(s[j])
            else:
                row.append("".join(extra).ljust(room[at], "-"))
                extra = []
                row.append(s[j] if j >= 0 else "-")
                at = i + 1
        row.append("".join(extra).ljust(room[at], "-"))
        out.append("".join(row))
    return out


def test_sum_of_pairs_is_no_worse_than_the_stars():
    ours = stars = worse = 0
    for seed in range(16):
        rng = random.Random(100 + seed)
        base = protein(rng, rng.randrange(60, 140))
        kinds = [base, changed(rng, base, 12), changed(rng, base, 12)]
        seqs = [changed(rng, rng.choice(kinds), rng.randrange(0, 10)) for _ in range(rng.randrange(3, 16))]
        rows = laid(seqs)
        assert [r.replace("-", "") for r in rows] == seqs and len({len(r) for r in rows}) == 1
        a, b = sum_of_pairs(rows), sum_of_pairs(star(seqs))
        ours, stars, worse = ours + a, stars + b, worse + (a < b)
    assert ours >= stars and worse <= 4


def test_planted_gaps_are_found():
    rng = random.Random(5)
    p = protein(rng, 90)
    seqs = [p, p[:30] + p[36:], p[:60] + "WWHWW" + p[60:], p[:30] + p[36:60] + "WWHWW" + p[60:], p]
    want = [p[:60] + "-----" + p[60:], p[:30] + "------" + p[36:60] + "-----" + p[60:], p[:60] + "WWHWW" + p[60:], p[:30] + "------" + p[36:60] + "WWHWW" + p[60:], p[:60] + "-----" + p[60:]]
    assert laid(seqs) == want


def test_merged_profiles_by_hand(monkeypatch):
    """A profile of one sequence is aligned like the sequence; a band wide enough changes nothing."""
    rng = random.Random(6)
    scores, open_, extend, _ = profiles.kind(True)
    for _ in range(30):
        a = protein(rng, rng.randrange(1, 50))
        b = changed(rng, a, rng.randrange(0, 6))
        (score, path), = al.aligned([(a.encode(), b.encode())], local=False)
        out, in_a, in_b = profiles.merged(profiles.profile(a), profiles.profile(b), scores, open_, extend)
        where = {c: i for i, c in enumerate(in_a.tolist())}, {c: j for j, c in enumerate(in_b.tolist())}
        ours, gap = 0, 0
        for c in range(len(out)):
            i, j = where[0].get(c), where[1].get(c)
            now = 0 if i is not None and j is not None else 1 if i is None else 2
            ours += int(al.SCORES[ord(a[i]), ord(b[j])]) if not now else -1 if now == gap else -12
            gap = now
        assert ours == score
        monkeypatch.setattr(profiles, "CELLS", 10)
        assert [x.tolist() for x in profiles.merged(profiles.profile(a), profiles.profile(b), scores, open_, extend)[1:]] == [in_a.tolist(), in_b.tolist()]
        monkeypatch.undo()
    empty = profiles.merged(profiles.profile(""), profiles.profile("AC"), scores, open_, extend)
    assert len(empty[0]) == 2 and len(empty[1]) == 0


def test_tree_joins_the_nearest_first():
    rng = random.Random(7)
    a, b = protein(rng, 80), protein(rng, 80)
    seqs = [a, b, changed(rng, a, 2), changed(rng, b, 2)]
    merges = profiles.tree([profiles.words(profiles.profile(s), 3) for s in seqs])
    assert {frozenset(m) for m in merges[:2]} == {frozenset((0, 2)), frozenset((1, 3))} and merges[2] == (0, 1)


@pytest.mark.parametrize("group", [64, 4])
def test_a_family_spans_tasks(spark, monkeypatch, group):
    """Levels of small groups; all rows of a family have one width and their own residues, copies are rows, and families of one stay as they are."""
    monkeypatch.setattr(msa, "GROUP", group)
    rng = random.Random(8)
    rows = []
    for f in range(3):
        p = protein(rng, 50)
        rows += [(f"f{f}", f"f{f}g{k:03}", changed(rng, p, rng.randrange(0, 4))) for k in range(40)]
    rows += [("f0", "copy", rows[0][2]), ("one", "alone", "MKV"), ("same", "x", "MKVA"), ("same", "y", "MKVA")]
    seen, grouped = [], msa._grouped
    monkeypatch.setattr(msa, "_grouped", lambda nodes: seen.append(grouped(nodes)) or seen[-1])
    got = msa.family_alignments(spark.createDataFrame(rows, "family string, gene_id string, seq string")).collect()
    assert len(got) == len(rows)
    by = {r.gene_id: r.aligned for r in got}
    assert all(by[g].replace("-", "") == s for _, g, s in rows) and by["copy"] == by["f0g000"] and by["alone"] == "MKV" and by["x"] == "MKVA"
    for f in range(3):
        assert len({len(by[g]) for x, g, _ in rows if x == f"f{f}"}) == 1
    assert len(seen) == (1 if group == 64 else 3)
    assert max(r["count"] for t in seen for r in t.groupBy("family", "group").count().collect()) <= group
    if group == 4:
        assert seen[0].filter(F.col("family") == "f0").select("group").distinct().count() >= 7


def test_nucleotides(spark):
    rows = [("f", "a", "ACGTACGTTTGACCA"), ("f", "b", "ACGTACTTGACCA"), ("f", "c", "ACGTACGTTTGACCAnn")]
    got = {r.gene_id: r.aligned for r in msa.family_alignments(spark.createDataFrame(rows, "family string, gene_id string, seq string"), False).collect()}
    assert {k: v.replace("-", "") for k, v in got.items()} == {g: s for _, g, s in rows} and len({len(v) for v in got.values()}) == 1
    assert got["a"][:6] == got["b"][:6] == "ACGTAC" and got["b"].count("-") == 4


def test_groups_are_aligned_side_by_side(spark, monkeypatch):
    """Profiles of many groups are aligned a batch at a time, with the results of one pair after the other."""
    rng = random.Random(9)
    scores, open_, extend, k = profiles.kind(True)
    groups = []
    for f in range(25):
        p = protein(rng, rng.randrange(1, 70))
        groups.append([profiles.profile(changed(rng, p, rng.randrange(0, 6))) for _ in range(rng.randrange(1, 9))])
    want = []
    for own in groups:
        at, places, under = list(own), [list(range(len(p))) for p in own], [[i] for i in range(len(own))]
        for i, j in profiles.tree([profiles.words(p, k) for p in own]) if len(own) > 1 else []:
            at[i], left, right = profiles.merged(at[i], at[j], scores, open_, extend)
            for x, to in ((i, left), (j, right)):
                for y in under[x]:
                    places[y] = [int(to[c]) for c in places[y]]
            under[i] += under[j]
        want.append((at[0].tolist(), places))
    alone, merged = [], profiles.merged
    monkeypatch.setattr(profiles, "merged", lambda *a: alone.append(1) or merged(*a))
    for most in (1 << 21, 3000):  # pairs too long for that are aligned alone
        monkeypatch.setattr(profiles, "TOGETHER", most)
        del alone[:]
        got = profiles.progressive_all(groups, True)
        assert [(one.tolist(), [p.tolist() for p in places]) for one, places in got] == want
        assert bool(alone) == (most < 1 << 21)
    # a task that holds little at a time has the same rows
    rows = [(f"f{f}", f"f{f}g{i}", changed(rng, "MKVLAARNDCQEGHILKMFPSTWYV", 2)) for f in range(9) for i in range(7)]
    t = spark.createDataFrame(rows, "family string, gene_id string, seq string")
    one = sorted(map(tuple, msa.family_alignments(t).collect()))
    monkeypatch.setattr(msa, "HELD", 1)
    assert sorted(map(tuple, msa.family_alignments(t).collect())) == one and len(one) == len(rows)


def test_profiles_that_surely_need_no_gaps_skip_the_recurrence(monkeypatch):
    """What is told to be straight is aligned so by the recurrence too, and near profiles never reach it."""
    rng = np.random.default_rng(4)
    scores, open_, extend, _ = profiles.kind(True)
    told = 0
    for _ in range(600):
        n = int(rng.integers(1, 70))
        base = rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), n)

        def some():
            out = np.zeros((n, profiles.LETTERS), np.float32)
            for _ in range(rng.integers(1, 4)):
                x = base.copy()
                at = rng.integers(0, n, rng.choice([0, 1, 2, 4, 8]))
                x[at] = rng.choice(list("ACDEFGHIKLMNPQRSTVWYX"), len(at))
                if rng.random() < 0.3:  # a residue that has moved: as long, and two gaps
                    x = np.insert(np.delete(x, rng.integers(n)), rng.integers(n), "W")
                p = profiles.profile("".join(x))
                if rng.random() < 0.4:
                    p[rng.integers(n) :][:3] = 0
                out += p
            return out

        a, b = some(), some()
        if profiles._straight([(a, b)], scores, open_, extend)[0]:
            told += 1
            both, left, right = profiles.merged(a, b, scores, open_, extend)
            assert np.array_equal(left, np.arange(n)) and np.array_equal(right, np.arange(n)) and np.array_equal(both, a + b)
    assert 100 < told < 600

    text = "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), 100))
    near, longer = (profiles.profile(x) for x in (text[:40] + "A" + text[41:], text[:40] + "WW" + text[40:]))
    calls = []
    recurrence = profiles._merged
    monkeypatch.setattr(profiles, "_merged", lambda pairs, *how: calls.append(len(pairs)) or recurrence(pairs, *how))
    profiles.merged_all([(profiles.profile(text), near), (profiles.profile(text), longer)], scores, open_, extend)
    assert calls == [1]


def test_alignments_never_go_through_the_driver(spark, monkeypatch):
    plans = []
    keep = msa.checkpoint
    monkeypatch.setattr(msa, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    t = spark.createDataFrame([(f"f{i % 3}", f"g{i}", "ACDEFGHIKL" + "MN"[i % 2] + "PQ" * (i > 3)) for i in range(9)], "family string, gene_id string, seq string")
    got = msa.family_alignments(t)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert got.count() == 9
    assert not [p for p in plans if "Broadcast" in p]
