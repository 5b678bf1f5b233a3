"""Near-identity dedup and all-against-all search of proteins.

Candidates come from seeds joined on equality. Each candidate pair is looked at once, in stages that cost more and leave fewer: edit distance by bit
vectors, or a stretch without gaps and a bound of what the band can score; then a band of the alignment; then its path. All work on many pairs at a time in Arrow functions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from genoloom import schemas
from genoloom.storage import checkpoint, drop

IDENTITY, LENGTH_RATIO, K, EVALUE, TARGETS = 0.98, 0.98, 12, 1e-6, 2000
#: Diagonals that seeds of one stretch may lie apart, the score without gaps that a pair must reach, and what its band has on either side.
SPREAD, TRIGGER, PAD = 16, 30, 24
#: What of a seed's set of sequences meets at a time.
SLICE = 256
#: Residues whose words are hashed, or whose windows are looked at, at a time.
TEXTS = 1 << 20
#: Of a search: residues of a block of sequences, places of words that meet at a time, and pairs whose paths are held at a time.
RESIDUES, MEETINGS, PATHS = 1 << 21, 1 << 21, 4096


def kmers(seqs: DataFrame, k: int = 5, keep: str = "gene_id") -> DataFrame:
    """Distinct words of ``k`` residues of each sequence (column aa)."""
    n = F.length("aa") - k + 1
    words = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(F.col("aa"), i, F.lit(k))))
    return seqs.filter(F.length("aa") >= k).select(keep, F.explode(words).alias("kmer"))


def shared_run(identity: float, ratio: float) -> int:
    """Residues in a row that any two sequences so alike in residues and length have in common.

    Of ``n`` residues of the shorter, ``lost`` at most are not identical. Each breaks a run, as does each residue that only the
    longer has: one for each that it is longer, and one for each lost residue that stands in a gap. Longer sequences than those
    looked at have longer runs than the least.
    """
    least = 10**9
    for n in range(1, 5001):
        same = math.ceil(identity * n - 1e-9)
        lost, more = n - same, math.floor(n / ratio + 1e-9) - n
        if lost or more:
            least = min(least, -(-same // (2 * lost + more + 1)))
    return max(least, 1)


def _seeds(texts: list[bytes], k: int, window: int):
    """(rows, seeds) of ``minimizers``, rows as places in ``texts``, sorted; all texts but short ones are hashed as one."""
    import numpy as np
    from numpy.lib.stride_tricks import sliding_window_view

    def hashed(x, w):
        h = np.zeros(max(len(x) - w + 1, 0), np.uint64)
        for j in range(w):
            h = h * np.uint64(0x100000001B3) + x[j : j + len(h)]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    length, who, seeds = np.array([len(x) for x in texts], np.int64), [], []
    least = k + window - 1
    long_ = np.flatnonzero(length >= least)
    if len(long_):
        x = np.frombuffer(b"".join([texts[i] for i in long_]), np.uint8).astype(np.uint64)
        low = sliding_window_view(hashed(x, k), window).min(axis=1)
        n, start = length[long_], np.cumsum(length[long_]) - length[long_]
        whole = np.arange(len(low)) - np.repeat(start, n)[: len(low)] <= np.repeat(n, n)[: len(low)] - least  # windows inside one text
        who.append(np.repeat(long_, n)[: len(low)][whole])
        seeds.append(low[whole])
    for i in np.flatnonzero((length > 0) & (length < least)):
        x = np.frombuffer(texts[i], np.uint8).astype(np.uint64)
        h = hashed(x, min(k, len(x)))
        low = sliding_window_view(h, min(window, len(h))).min(axis=1)
        who.append(np.full(len(low), i))
        seeds.append(low)
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, seeds = np.concatenate(who), np.concatenate(seeds).view(np.int64)
    order = np.lexsort((seeds, who))
    who, seeds = who[order], seeds[order]
    new = np.concatenate([[True], (np.diff(who) != 0) | (seeds[1:] != seeds[:-1])])
    return who[new], seeds[new]


def minimizers(seqs: DataFrame, k: int, window: int) -> DataFrame:
    """(ord, seed): of any ``window`` words in a row the one with the least hash, so that two sequences that share
    ``window + k - 1`` residues in a row share a seed. Sequences are dealt over all partitions first, as a table of one small file is one task's."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ords, texts = b.column(0).to_numpy(zero_copy_only=False), [aa.encode() for aa in b.column(1).to_pylist()]
            ends = np.cumsum([len(x) for x in texts])
            at = 0
            while at < len(texts):  # some texts at a time
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXTS, "right")))
                who, seeds = _seeds(texts[at:to], k, window)
                yield pa.RecordBatch.from_arrays([pa.array(ords[at:to][who], pa.int64()), pa.array(seeds)], names=["ord", "seed"])
                at = to

    parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seqs.select("ord", "aa").repartition(parts, "ord").mapInArrow(run, "ord long, seed long")


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) over all partitions: aligning costs far more than they weigh, so that partitions are not to be put together by their
    size, and a sequence with many partners is not to be one task's."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")


def _differ(x: bytes, y: bytes) -> int:
    """Places at which two texts of one length differ."""
    z = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
    return len(x) - z.to_bytes(len(x), "little").count(0)


def _identities(pairs: DataFrame, identity: float = IDENTITY) -> DataFrame:
    """(a, b, identity) of (a, b, aa_a, aa_b), identical residues over the shorter length, where it may reach ``identity``.

    With ``same`` identical residues the edit distance is at most what either has besides. Pairs beyond that bound go
    first, and all others are aligned in a band of its width; those of equal length that no gap can better are counted where they are.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from genoloom.functions import banded

        for b in batches:
            every = [(x.encode(), y.encode()) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            short = np.array([min(len(x), len(y)) for x, y in every])
            most = np.array([len(x) + len(y) for x, y in every]) - 2 * np.ceil(identity * short - 1e-9).astype(np.int64)
            count = np.full(len(every), -1, np.int64)
            even = np.array([k for k, (x, y) in enumerate(every) if len(x) == len(y) <= 1000 and most[k] <= 16], np.int64)  # short enough that sums are small numbers
            if len(even):
                differ = np.array([_differ(*every[k]) for k in even.tolist()])
                even = even[differ <= most[even]]
                if len(even):
                    count[even] = banded.identities_without_gaps([every[k] for k in even.tolist()], int(most[even].max()) + 1)
            rest = np.flatnonzero(count < 0)
            order, near = rest[np.argsort(short[rest], kind="stable")], np.zeros(len(every), bool)
            for k in range(0, len(order), 1024):
                own = order[k : k + 1024]
                near[own] = banded.edit_distances([every[i] for i in own]) <= most[own]
            at = np.flatnonzero(near)
            count[at] = banded.identities([every[i] for i in at], [(-int(most[i]) - 1, int(most[i]) + 1) for i in at])
            at = np.flatnonzero(count >= 0)
            out = count[at] / short[at]
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(out, pa.float64())], names=["a", "b", "identity"])

    return _dealt(pairs.select("a", "b", "aa_a", "aa_b")).mapInArrow(run, "a long, b long, identity double")


def _met(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(a, b), distinct, of what shares a seed: of ``left`` and ``right`` (ord, seed), or a < b of ``left`` alone.

    Sequences that are alike share most of their seeds, so sets that seeds have in common are looked at once before they become pairs. Large sets
    are cut into slices, each of which meets each, so that no task has the pairs of one seed.
    """
    if right is None:
        sets = left.groupBy("seed").agg(F.sort_array(F.collect_list("ord")).alias("l")).filter("size(l) > 1").withColumn("r", F.col("l"))
    else:
        both = left.select("seed", F.col("ord").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(right.select("seed", F.lit(None).cast("long").alias("a"), F.col("ord").alias("b")))
        sets = both.groupBy("seed").agg(F.sort_array(F.collect_list("a")).alias("l"), F.sort_array(F.collect_list("b")).alias("r")).filter("size(l) > 0 AND size(r) > 0")
    last = lambda c: F.floor((F.size(c) - 1) / SLICE).cast("int")
    sets = sets.withColumn("i", F.explode(F.sequence(F.lit(0), last("l")))).withColumn("j", F.explode(F.sequence(F.col("i") if right is None else F.lit(0), last("r"))))
    of = lambda c, k: F.slice(c, F.col(k) * SLICE + 1, F.lit(SLICE))
    sets = sets.select(of("l", "i").alias("l"), of("r", "j").alias("r")).distinct()
    pairs = sets.select(F.explode("l").alias("a"), "r").select("a", F.explode("r").alias("b"))
    return (pairs.filter("a < b") if right is None else pairs).distinct()


def _candidates(left: DataFrame, right: DataFrame, identity: float, ratio: float, both: bool) -> DataFrame:
    """Pairs that share a seed, as all of that identity do, and are alike in length; with ``both`` sides the same table, a < b."""
    run = shared_run(identity, ratio)
    k = min(K, run)
    l, r = (minimizers(t, k, run - k + 1) for t in (left, right))
    pairs = _met(l, None if both else r)
    pairs = pairs.join(left.select(F.col("ord").alias("a"), F.col("aa").alias("aa_a")), "a").join(right.select(F.col("ord").alias("b"), F.col("aa").alias("aa_b")), "b")
    n, m = F.length("aa_a"), F.length("aa_b")
    return pairs.filter(F.least(n, m) >= ratio * F.greatest(n, m))


def near_identical(seqs: DataFrame, identity: float = IDENTITY, ratio: float = LENGTH_RATIO) -> DataFrame:
    """(rep_id, member_id, member_ord) of (seq_ord, gene_id, aa); member_id is null for a representative alone.

    Longest first, ties by seq_ord: a sequence is a representative unless an earlier representative is alike. Done in
    rounds: whoever has no undecided earlier neighbour becomes a representative, and its neighbours are taken. A
    sequence belongs to the most similar of its representatives. Equal sequences are one in all this.
    """
    seqs = checkpoint(seqs.select("seq_ord", "gene_id", "aa"))
    one = seqs.groupBy("aa").agg(F.min_by("gene_id", "seq_ord").alias("gene_id"), F.min("seq_ord").alias("seq_ord"))
    one = checkpoint(one.withColumn("ord", F.col("seq_ord")))
    rank = one.select("ord", F.struct((-F.length("aa")).alias("l"), "ord").alias("rank"))
    edges = _identities(_candidates(one, one, identity, ratio, True), identity).filter(F.col("identity") >= identity)
    edges = edges.join(rank.withColumnsRenamed({"ord": "a", "rank": "ra"}), "a").join(rank.withColumnsRenamed({"ord": "b", "rank": "rb"}), "b")
    first, last = (F.when(F.col("ra") < F.col("rb"), F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    edges = checkpoint(edges.select(first.alias("a"), last.alias("b"), "identity"))  # a comes before b; turned where it is, as a union would align all pairs twice
    state = checkpoint(one.select("ord", F.lit(0).alias("state")))  # 0 undecided, 1 representative, 2 taken
    while not state.filter("state = 0").isEmpty():
        open_ = state.filter("state = 0").select("ord")
        waits = edges.join(open_.withColumnRenamed("ord", "a"), "a", "left_semi").select(F.col("b").alias("ord")).distinct()
        new = open_.join(waits, "ord", "left_anti")
        taken = edges.join(new.withColumnRenamed("ord", "a"), "a", "left_semi").select(F.col("b").alias("ord")).distinct()
        marks = new.withColumn("now", F.lit(1)).unionByName(taken.withColumn("now", F.lit(2)))
        last, state = state, checkpoint(state.join(marks, "ord", "left").select("ord", F.when(F.col("state") == 0, F.coalesce("now", F.lit(0))).otherwise(F.col("state")).alias("state")))
        drop(last)
    reps = state.filter("state = 1").select("ord")
    best = edges.join(reps.withColumnRenamed("ord", "a"), "a", "left_semi").groupBy("b").agg(F.max_by("a", F.struct("identity", -F.col("a"))).alias("rep"))
    owner = state.join(best, state["ord"] == best["b"], "left").select("ord", F.when(F.col("state") == 1, F.col("ord")).otherwise(F.col("rep")).alias("rep"))
    owner = owner.join(one.select("ord", "aa"), "ord").join(one.select(F.col("ord").alias("rep"), F.col("gene_id").alias("rep_id")), "rep").select("aa", "rep_id")
    members = seqs.join(owner, "aa").filter("gene_id <> rep_id").select("rep_id", F.col("gene_id").alias("member_id"), F.col("seq_ord").alias("member_ord"))
    alone = owner.select("rep_id").distinct().join(members, "rep_id", "left_anti").select("rep_id", F.lit(None).cast("string").alias("member_id"), F.lit(None).cast("long").alias("member_ord"))
    return members.unionByName(alone)


def matched_to(new: DataFrame, reps: DataFrame, identity: float = IDENTITY, ratio: float = LENGTH_RATIO) -> tuple[DataFrame, DataFrame]:
    """((rep_id, member_id, member_ord), unmatched rows of ``new``): new sequences to their most similar saved representative."""
    n, r = new.withColumn("ord", F.col("seq_ord")), checkpoint(reps.withColumn("ord", F.col("seq_ord")))
    n = checkpoint(n)
    found = _identities(_candidates(n, r, identity, ratio, False), identity).filter(F.col("identity") >= identity)
    best = checkpoint(found.groupBy("a").agg(F.max_by("b", F.struct("identity", -F.col("b"))).alias("b")))
    members = best.join(n.select(F.col("ord").alias("a"), F.col("gene_id").alias("member_id")), "a").join(r.select(F.col("ord").alias("b"), F.col("gene_id").alias("rep_id")), "b")
    return members.select("rep_id", "member_id", F.col("a").alias("member_ord")), n.join(best.select(F.col("a").alias("ord")), "ord", "left_anti").drop("ord")


def _marked(seqs: DataFrame, mask: bool) -> DataFrame:
    """(ord, gene_id, aa, low): low has a bit for each residue in a stretch of low complexity, as such stretches are alike in proteins that
    have nothing else in common; null where there are none, or without ``mask``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from genoloom.functions.banded import low_complexities

        for b in batches:
            texts, low = [aa.encode() for aa in b.column(2).to_pylist()], []
            ends = np.cumsum([len(x) for x in texts])
            while mask and len(low) < len(texts):  # some texts at a time
                at = len(low)
                low += low_complexities(texts[at : max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXTS, "right")))])
            bits = pa.array([np.packbits(x).tobytes() if x.any() else None for x in low] if mask else [None] * len(texts), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(3)), bits], names=["ord", "gene_id", "aa", "low"])

    return seqs.select("ord", "gene_id", "aa").mapInArrow(run, "ord long, gene_id string, aa string, low binary")


class _Block:
    """Sequences one after the other, a zero between, and their words of ``k`` residues in the order of their places."""

    def __init__(self, rows: list, k: int):
        import numpy as np

        self.ord, self.ids, self.texts = np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], [r[2].encode() for r in rows]
        self.x = np.frombuffer(b"\0".join([*self.texts, b""]), np.uint8)
        self.length = np.array([len(x) for x in self.texts], np.int64)
        self.start = np.cumsum(self.length + 1) - self.length - 1
        usable = self.x != 0
        for r, start, n in zip(rows, self.start.tolist(), self.length.tolist(), strict=True):
            if r[3] is not None:
                usable[start : start + n] &= np.unpackbits(np.frombuffer(r[3], np.uint8), count=n) == 0
        n = max(len(self.x) - k + 1, 0)
        word, keep = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k):
            word = word << 8 | self.x[j : n + j]
            keep &= usable[j : n + j]
        self.at = np.flatnonzero(keep)
        self.word, self.who = word[self.at], np.repeat(np.arange(len(rows)), self.length + 1)[self.at]
        self.place = self.at - self.start[self.who]


def _sorted(word):
    """The stable order of words; those of five residues are sorted together with their places, which is faster."""
    import numpy as np

    if len(word) >> 23 or int(word.max(initial=0)) >> 40:
        return np.argsort(word, kind="stable")
    return np.sort(word << 23 | np.arange(len(word))) & ((1 << 23) - 1)


def _near_diagonals(left: _Block, right: _Block, shared: int, same: bool):
    """(a, b, d), sorted: diagonals of pairs of sequences with ``shared`` words at most ``SPREAD`` diagonals away; of one block with itself only
    pairs that are in order. A few sequences of the left at a time, so that no more than ``MEETINGS`` places of words meet at once."""
    import numpy as np

    by, own = (_sorted(x.word) for x in (right, left))
    words = right.word[by]
    first, n = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    first[own] = np.searchsorted(words, left.word[own], "left")
    n[own] = np.searchsorted(words, left.word[own], "right") - first[own]
    ends = np.searchsorted(left.who, np.arange(len(left.ids)), "right")
    total, most = np.concatenate([[0], np.cumsum(n)]), int(left.length.max(initial=0))
    span, wide = most + int(right.length.max(initial=0)) + 2 * SPREAD + 2, len(right.ids)
    a0, p0 = 0, 0
    while a0 < len(ends):
        a1 = max(a0 + 1, int(np.searchsorted(total[ends], total[p0] + MEETINGS, "right")))
        p1 = int(ends[a1 - 1])
        at = np.repeat(np.arange(p0, p1), n[p0:p1])
        to = by[first[at] + np.arange(len(at)) - (total[at] - total[p0])]
        a, b = left.who[at], right.who[to]
        key = ((a - a0) * wide + b) * span + right.place[to] - left.place[at] + most + SPREAD
        if same:
            key = key[left.ord[a] <= right.ord[b]]
        del at, to, a, b
        key.sort()
        if shared > 1:  # what has no other near goes first
            near, close = np.zeros(len(key), bool), np.diff(key) <= SPREAD
            near[1:] |= close
            near[:-1] |= close
            key = key[near]
        key = key[np.searchsorted(key, key + SPREAD, "right") - np.searchsorted(key, key - SPREAD, "left") >= shared]
        key = key[np.diff(key, prepend=-1) > 0]
        if len(key):
            pair, d = np.divmod(key, span)
            yield pair // wide + a0, pair % wide, d - most - SPREAD
        a0, p0 = a1, p1


def _hits_of(left: _Block, right: _Block, shared: int, database: int, evalue: float, both: bool, same: bool):
    """Rows of hits of two blocks. Near diagonals are extended without gaps; a pair whose best stretch reaches ``TRIGGER`` is scored in a
    band about its diagonals unless a bound of the band's scores shows that it can't count, as it does of nearly all that meet by chance, and only one that counts gets its path. With ``both``, hits are told for both sides."""
    import numpy as np

    from genoloom.functions import banded
    from genoloom.functions.alignment import LAMBDA, K as KARLIN, hit, whole_hit

    for a, b, d in _near_diagonals(left, right, shared, same):
        i, j = np.maximum(0, -d), np.maximum(0, d)
        best = banded.stretches(left.x, right.x, left.start[a] + i, right.start[b] + j, np.minimum(left.length[a] - i, right.length[b] - j))
        of = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))  # where a pair begins
        good = np.maximum.reduceat(best, of) >= TRIGGER
        ends = np.append(of[1:], len(a)) - 1
        near = [x[good] for x in (a[of], b[of], d[of] - SPREAD - PAD, d[ends] + SPREAD + PAD)]
        bound = banded.score_bounds(left.texts, right.texts, *near)
        may = KARLIN * np.minimum(left.length[near[0]], right.length[near[1]]) * database * np.exp(-LAMBDA * bound) <= evalue * (1 + 1e-9)
        rows, pairs, bands, own = [], [], [], []
        for u, v, lo, hi in zip(*(x[may].tolist() for x in near), strict=True):
            if left.texts[u] == right.texts[v] and lo <= 0 <= hi and (h := whole_hit(left.texts[u], database)):
                q, t, n = left.ids[u], right.ids[v], len(left.texts[u])
                if h[8] <= evalue:
                    own += [(q, t, *h, n, n)] + [(t, q, *h, n, n)] * (both and q != t)
                continue
            turn = both and left.ord[u] > right.ord[v]  # the earlier comes first, whatever block it is in
            rows.append((right.ids[v], left.ids[u]) if turn else (left.ids[u], right.ids[v]))
            pairs.append((right.texts[v], left.texts[u]) if turn else (left.texts[u], right.texts[v]))
            bands.append((-hi, -lo) if turn else (lo, hi))
        if own:
            yield own
        at = [p for p, (score, _) in enumerate(banded.aligned(pairs, bands, paths=False)) if KARLIN * min(map(len, pairs[p])) * database * math.exp(-LAMBDA * score) <= evalue]
        for m in range(0, len(at), PATHS):
            some, out = at[m : m + PATHS], []
            for p, (score, path) in zip(some, banded.aligned([pairs[p] for p in some], [bands[p] for p in some]), strict=True):
                (q, t), (x, y) = rows[p], (z.decode() for z in pairs[p])
                sides = [(q, t, x, y, path)] + [(t, q, y, x, [(j, i) for i, j in path])] * (both and q != t)
                for qid, sid, x, y, way in sides:
                    h = hit(x.encode(), y.encode(), score, way, database)
                    if h[8] <= evalue:
                        out.append((qid, sid, *h, len(x), len(y)))
            yield out


def _compared(k: int, shared: int, database: int, evalue: float, both: bool):
    """For batches of (i, j, side, ord, gene_id, aa, low), the rows of a cell of the grid one after the other: the hits."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in schemas.HITS.split(", ")]
        kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
        types = [kinds[c.split()[1]] for c in schemas.HITS.split(", ")]

        def hits(cell, sides):
            if all(sides):
                for rows in _hits_of(*(_Block(s, k) for s in sides), shared, database, evalue, both, both and cell[0] == cell[1]):
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)

        cell, sides = None, ([], [])
        for b in batches:
            for i, j, side, *row in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
                if (i, j) != cell:
                    yield from hits(cell, sides)
                    cell, sides = (i, j), ([], [])
                sides[side].append(row)
        yield from hits(cell, sides)

    return run


def _grid(q: DataFrame, t: DataFrame, sizes: tuple[int, int], both: bool) -> DataFrame:
    """Sequences dealt into blocks of ``RESIDUES`` on either side, and a copy of each for every block that it meets: a cell (i, j) is two blocks. With
    ``both`` sides the same, i <= j."""
    parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = math.ceil(math.sqrt(parts * (2 if both else 1)))  # so that small tables are many tasks too
    gq, gt = (max(least, -(-n // RESIDUES)) for n in sizes)
    block = lambda g: F.pmod(F.xxhash64("ord"), F.lit(g)).cast("int")
    every = lambda lo, hi: F.explode(F.sequence(lo, hi))
    rows = ["ord", "gene_id", "aa", "low"]
    left = q.select(block(gq).alias("i"), *rows).select("i", every(F.col("i") if both else F.lit(0), F.lit(gt - 1)).alias("j"), F.lit(0).alias("side"), *rows)
    right = t.select(block(gt).alias("j"), *rows).select(every(F.lit(0), F.col("j") if both else F.lit(gq - 1)).alias("i"), "j", F.lit(1).alias("side"), *rows)
    return left.unionByName(right).repartition(parts, "i", "j").sortWithinPartitions("i", "j")


def search(queries: DataFrame, targets: DataFrame, evalue: float = EVALUE, k: int = 5, shared: int = 2, best: int = TARGETS, mask: bool = True) -> DataFrame:
    """Hits of every query against every target (gene_id, aa), by local alignment of pairs that share at least ``shared`` words of
    ``k`` residues, 8 at most, on diagonals no more than ``SPREAD`` apart. A table against itself has each pair aligned once, for both sides.

    Words that meet by chance are as many as pairs, so they never leave a task: blocks of sequences meet as the cells of a grid, and only
    hits come out."""
    from genoloom.operators.hits import best_targets

    if not 0 < k <= 8:
        raise ValueError("words of 1 to 8 residues")
    both = queries is targets
    t = checkpoint(_marked(targets.select(F.monotonically_increasing_id().alias("ord"), "gene_id", "aa"), mask))
    q = t if both else checkpoint(_marked(queries.select(F.monotonically_increasing_id().alias("ord"), "gene_id", "aa"), mask))
    sizes = [own.agg(F.sum(F.length("aa"))).first()[0] or 0 for own in ([t] if both else [q, t])]
    return best_targets(_grid(q, t, (sizes[0], sizes[-1]), both).mapInArrow(_compared(k, shared, sizes[-1], evalue, both), schemas.HITS), best)
