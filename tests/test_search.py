"""The stages of protein search and near identity, each against a plain version."""

import random

import numpy as np
import pytest
from genome import mutated, protein
from hypothesis import given, settings, strategies as st

from genoloom.functions import alignment, banded
from genoloom.operators import hits, similarity

RESIDUES = alignment.RESIDUES


def changed(rng, p, k):
    """``p`` with ``k`` residues replaced, put in or taken out."""
    p = list(p)
    for _ in range(k):
        i, kind = rng.randrange(len(p)), rng.random()
        if kind < 0.15:
            p.insert(i, rng.choice(RESIDUES))
        elif kind < 0.3 and len(p) > 1:
            p.pop(i)
        else:
            p[i] = rng.choice(RESIDUES)
    return "".join(p)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ACDW", max_size=140), st.text("ACDW", max_size=140)), min_size=1, max_size=4))
def test_edit_distances(pairs):
    assert banded.edit_distances([(a.encode(), b.encode()) for a, b in pairs]).tolist() == [edits(a, b) for a, b in pairs]


def test_wide_bands_give_what_the_whole_gives():
    rng, pairs = random.Random(3), []
    for _ in range(120):
        a = "".join(rng.choices(RESIDUES, k=rng.randrange(1, 110)))
        pairs.append((a.encode(), (changed(rng, a, rng.randrange(0, 50)) if rng.random() < 0.8 else protein(rng, 60)).encode()))
    whole = [x for p in pairs for x in alignment.aligned([p])]
    assert banded.aligned(pairs, [(-len(a), len(b)) for a, b in pairs]) == whole
    assert [s for s, _ in banded.aligned(pairs, [(-len(a), len(b)) for a, b in pairs], paths=False)] == [s for s, _ in whole]


def test_bands_are_kept():
    rng = random.Random(4)
    a = protein(rng, 80)
    b = a[:40] + protein(rng, 30) + a[40:]
    for lo, hi in ((0, 0), (-3, 3), (28, 31), (-5, 40)):
        (score, path), = banded.aligned([(a.encode(), b.encode())], [(lo, hi)])
        assert score > 0 and all(lo <= j - i <= hi for i, j in path if i >= 0 and j >= 0)
    assert banded.aligned([(a.encode(), b.encode())], [(-5, 40)])[0] == alignment.aligned([(a.encode(), b.encode())])[0]


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(banded, "CELLS", 5000)
    pairs, bands = [(b"A" * n, b"A" * n) for n in (10, 300, 20, 90, 10, 10)], [(-2, 2), (-9, 9), (-2, 2), (0, 40), (-2, 2), (-2, 2)]
    own = banded.batches(pairs, bands)
    assert sorted(k for x in own for k in x) == list(range(6))
    for x in own:
        assert len(x) == 1 or len(x) * max(len(pairs[k][0]) + 1 for k in x) * max(bands[k][1] - bands[k][0] + 1 for k in x) <= 5000
    assert [s for s, _ in banded.aligned(pairs, bands)] == [s for s, _ in alignment.aligned(pairs)]


def test_bounds_hold_and_tell_chance_from_kin(monkeypatch):
    """No band scores above its bound, whatever the texts, bands and batches; of random proteins that share a word nearly all stay far below what kin score."""
    rng, texts, others, rows = random.Random(21), [], [], []
    for k in range(150):
        letters = rng.choice(["ACW", RESIDUES, RESIDUES, RESIDUES + "*x"])
        a = "".join(rng.choices(letters, k=rng.randrange(0, 120)))
        b = changed(rng, a, rng.randrange(0, 60)) if a and rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randrange(0, 120)))
        texts.append(a.encode())
        others.append(b.encode())
    for k in range(600):
        a, b, lo = rng.randrange(150), rng.randrange(150), rng.randrange(-130, 120)
        rows.append((k % 150, k % 150, -20, 20) if k < 300 else (a, b, lo, lo + rng.choice([0, 6, 40, 80, 118, 119, 140])))
    a, b, lo, hi = np.array(rows).T
    bound = banded.score_bounds(texts, others, a, b, lo, hi)
    score = np.array([x for i, j, l, h in rows for x, _ in banded.aligned([(texts[i], others[j])], [(l, h)], paths=False)])
    assert (bound >= score).all() and (bound[hi - lo >= 120] == banded.BEYOND).all() and (score > 100).sum() > 20 and (bound < banded.BEYOND).sum() > 250
    monkeypatch.setattr(banded, "SPACED", 300)
    monkeypatch.setattr(banded, "PAIRS", 7)
    few = banded.score_bounds(texts, others, a, b, lo, hi)
    assert (few >= score).all() and (few <= bound + 128).all()
    word = protein(rng, 6)
    chance = [(protein(rng, 48) + word + protein(rng, 48)).encode() for _ in range(200)]
    at = np.arange(200)
    assert (banded.score_bounds(chance, chance[::-1], at, at, np.full(200, -40), np.full(200, 40)) < 110).mean() > 0.95


def test_only_pairs_that_may_count_are_scored_in_bands(spark, monkeypatch):
    """Random proteins that share six residues meet, but no recurrence is run for them."""
    rng = random.Random(22)
    word = "WCHWCM"
    rows = [(k, f"g{k:02}", protein(rng, 48) + word + protein(rng, 48), None) for k in range(40)]
    block, scored, aligned = similarity._Block(rows, 5), [], banded.aligned
    monkeypatch.setattr(banded, "aligned", lambda pairs, *how, **more: scored.extend(pairs) or aligned(pairs, *how, **more))
    hits_ = lambda: sorted(h for part in similarity._hits_of(block, block, 2, 10**8, 1e-6, True, True) for h in part)
    few, n = hits_(), len({p for p in scored if p[0] != p[1]})
    assert n < 200
    monkeypatch.setattr(banded, "score_bounds", lambda texts, others, a, b, lo, hi: np.full(len(a), banded.BEYOND))
    scored.clear()
    assert hits_() == few and len(few) >= 40 and len({p for p in scored if p[0] != p[1]}) == 40 * 39 // 2


def test_identities_are_those_of_paths():
    rng, pairs = random.Random(23), []
    for _ in range(900):
        letters = rng.choice(["AC", "ACD", RESIDUES, RESIDUES + "*x"])
        a = "".join(rng.choices(letters, k=rng.randrange(1, 60)))
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            b[rng.randrange(len(b))] = rng.choice(letters)
        if rng.random() < 0.3:  # one out and one in elsewhere
            b.insert(rng.randrange(len(b)), b.pop(rng.randrange(len(b))))
        pairs.append((a.encode(), "".join(b).encode()))
    whole = [sum(i >= 0 and j >= 0 and a[i] == b[j] for i, j in path) for (a, b), (_, path) in zip(pairs, banded.aligned(pairs, [(-5, 5)] * len(pairs)), strict=True)]
    assert banded.identities(pairs, [(-5, 5)] * len(pairs)).tolist() == whole
    sure = banded.identities_without_gaps(pairs, 5)
    assert all(x in (-1, y) for x, y in zip(sure.tolist(), whole, strict=True)) and (sure >= 0).sum() > 450 and (sure < 0).sum() > 50


def test_ungapped():
    rng = random.Random(6)
    for _ in range(50):
        a, b = (np.frombuffer(protein(rng, rng.randrange(1, 40)).encode(), np.uint8) for _ in range(2))
        d = rng.randrange(-len(a) - 2, len(b) + 3)
        own = [int(alignment.SCORES[a[i], b[i + d]]) for i in range(len(a)) if 0 <= i + d < len(b)]
        assert banded.ungapped(a, b, d) == max([0, *(sum(own[i:j]) for i in range(len(own)) for j in range(i + 1, len(own) + 1))])


def test_low_complexity():
    from collections import Counter
    from math import log2

    rng = random.Random(7)
    for seq in ("M" * 30, "AC" * 20, protein(rng, 60), protein(rng, 30) + "QQQQQQPQQQQQ" + protein(rng, 30), "ACD", ""):
        want = [False] * len(seq)
        for i in range(len(seq) - 11):
            if -sum(c / 12 * log2(c / 12) for c in Counter(seq[i : i + 12]).values()) < 2.2 - 1e-12:
                want[i : i + 12] = [True] * 12
        assert banded.low_complexity(seq.encode()).tolist() == want


def test_low_complexity_of_many_is_that_of_each():
    rng = random.Random(24)
    seqs = ["".join(rng.choices(rng.choice(["AC", "ACDEF", RESIDUES]), k=rng.choice([0, 1, 5, 11, 12, 13, 40]))).encode() for _ in range(300)]
    got = banded.low_complexities(seqs)
    assert [x.tolist() for x in got] == [banded.low_complexity(x).tolist() for x in seqs] and 0 < sum(x.sum() for x in got) < sum(map(len, seqs))
    assert [len(x) for x in banded.low_complexities([b""])] == [0]


def test_a_sequence_against_itself_needs_no_alignment():
    rng = random.Random(25)
    for seq in [protein(rng, n) for n in (1, 7, 60)] + ["A" * 30, "WCWCWCWC"]:
        (score, path), = alignment.aligned([(seq.encode(), seq.encode())])
        assert alignment.whole_hit(seq.encode(), 5000) == alignment.hit(seq.encode(), seq.encode(), score, path, 5000)
    assert alignment.whole_hit(b"ACX*", 5000) is None and alignment.whole_hit(b"", 5000) is None


def exact_hits(rows, evalue):
    """All pairs by whole alignments."""
    database, out = sum(len(aa) for _, aa in rows), {}
    for q, x in rows:
        for s, y in rows:
            (score, path), = alignment.aligned([(x.encode(), y.encode())])
            if path and (h := alignment.hit(x.encode(), y.encode(), score, path, database))[8] <= evalue:
                out[q, s] = h
    return out


def test_recall_against_whole_alignments(spark):
    """Families of all distances, with gaps. Of hits that the default thresholds keep, 99 % at least are found, and a hit that is found
    is nearly always the whole alignment's."""
    rng, rows = random.Random(8), []
    for f in range(9):
        p = protein(rng, rng.randrange(70, 130))
        rows += [(f"f{f}m{k}", changed(rng, p, rng.choice([0, 2, 5, 12, 20, 35]))) for k in range(5)]
    t = spark.createDataFrame(rows, "gene_id string, aa string")
    found = similarity.search(t, t)
    got = {(r.qseqid, r.sseqid): r for r in found.collect()}
    want = exact_hits(rows, 1e-6)
    assert set(got) <= set(want)
    kept = {k for k, h in want.items() if h[0] > 70 and min(len(dict(rows)[x]) for x in k) > 0.7 * max(len(dict(rows)[x]) for x in k)}
    assert len(kept) > 80 and len(kept & set(got)) >= 0.99 * len(kept)
    same = [abs(got[k].bitscore - want[k][9]) < 1e-9 and abs(got[k].pident - want[k][0]) < 1e-9 for k in kept & set(got)]
    assert sum(same) >= 0.99 * len(same)
    assert {(r.qseqid, r.sseqid) for r in hits.filtered(found).collect()} >= {k for k in kept if k[0] != k[1]} - {k for k in kept if k not in got}
    one = spark.createDataFrame(rows, "gene_id string, aa string")
    assert {(r.qseqid, r.sseqid) for r in similarity.search(t, one).collect()} == set(got)


@pytest.mark.parametrize("mask", [True, False])
def test_stretches_of_low_complexity_link_nothing(spark, mask):
    rng = random.Random(9)
    repeat = "QQPQQQQPQQQQQQPQQQQQQQPQQQQQPQQQQQQQQPQQQ"
    p = protein(rng, 80)
    rows = [("a", protein(rng, 80) + repeat), ("b", repeat + protein(rng, 80)), ("c", p + repeat), ("d", mutated(rng, p, 0.05))]
    t = spark.createDataFrame(rows, "gene_id string, aa string")
    got = {(r.qseqid, r.sseqid) for r in similarity.search(t, t, mask=mask).collect()}
    assert {("c", "d"), ("d", "c"), ("a", "a")} <= got
    assert (("a", "b") in got) == (not mask) and (("a", "c") in got) == (not mask)


def test_identity_bound_loses_nothing(spark):
    """Every pair whose whole alignment is as identical passes the bound of edits."""
    rng, rows = random.Random(10), []
    for k in range(40):
        p = protein(rng, rng.randrange(50, 160))
        for _ in range(4):
            rows.append((len(rows), p, changed(rng, p, rng.randrange(0, 6))))
    t = spark.createDataFrame([(k, k + 1000, a, b) for k, a, b in rows], "a long, b long, aa_a string, aa_b string")
    for identity in (0.98, 0.95):
        got = {r.a: r.identity for r in similarity._identities(t, identity).filter(f"identity >= {identity}").collect()}
        want = {}
        for k, a, b in rows:
            (_, path), = alignment.aligned([(a.encode(), b.encode())])
            same = sum(i >= 0 and j >= 0 and a[i] == b[j] for i, j in path) / min(len(a), len(b))
            if same >= identity:
                want[k] = same
        assert got == want and 20 < len(want) < len(rows)


def test_seeds_of_a_search_never_leave_a_task(spark, monkeypatch):
    """Blocks of sequences meet inside tasks, whatever their sizes; what is shuffled is sequences and hits, and no pair of seeds."""
    rng, rows = random.Random(11), []
    for f in range(5):
        p = protein(rng, rng.randrange(60, 110))
        rows += [(f"f{f}m{k}", changed(rng, p, rng.choice([0, 3, 9]))) for k in range(6)]
    t = spark.createDataFrame(rows, "gene_id string, aa string").cache()
    whole = similarity.search(t, t)
    assert "word" not in (plan := whole._jdf.queryExecution().optimizedPlan().toString()) and "Join" not in plan and "MapInArrow" in plan
    want = sorted(map(tuple, whole.collect()))
    assert len(want) > 100
    monkeypatch.setattr(similarity, "RESIDUES", 300)
    monkeypatch.setattr(similarity, "MEETINGS", 5)
    monkeypatch.setattr(similarity, "PATHS", 3)
    assert sorted(map(tuple, similarity.search(t, t).collect())) == want
    # diagonals of pairs by the rule itself
    blocks = [similarity._Block([(k, g, aa, None) for k, (g, aa) in enumerate(rows[lo:hi], lo)], 3) for lo, hi in ((0, 13), (13, 30))]
    for left, right, same in ((*blocks, False), (blocks[0], blocks[0], True)):
        met = {}
        for i, x in enumerate(left.texts):
            for j, y in enumerate(right.texts):
                if not same or left.ord[i] <= right.ord[j]:
                    ds = [v - u for u in range(len(x) - 2) for v in range(len(y) - 2) if x[u : u + 3] == y[v : v + 3]]
                    if near := sorted({d for d in ds if sum(abs(d - e) <= similarity.SPREAD for e in ds) >= 2}):
                        met[i, j] = near
        got = [tuple(map(int, x)) for part in similarity._near_diagonals(left, right, 2, same) for x in zip(*part, strict=True)]
        assert got == [(i, j, d) for (i, j), ds in sorted(met.items()) for d in ds] and len(got) > 30
        for i, j, d in got[:200]:
            u, v = max(0, -d), max(0, d)
            n = min(len(left.texts[i]) - u, len(right.texts[j]) - v)
            one = banded.stretches(left.x, right.x, left.start[[i]] + u, right.start[[j]] + v, np.array([n]))
            assert one[0] == banded.ungapped(*(np.frombuffer(x, np.uint8) for x in (left.texts[i], right.texts[j])), d)
