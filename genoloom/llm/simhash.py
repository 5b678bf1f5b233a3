"""SimHash near-dedup with exact linking at a Hamming distance.

Fingerprints are cut into segments of two bits and mapped to the segments' bit counts. The Manhattan distance
of two such vectors is never more than the Hamming distance, so it serves as a lower bound: of two halves of
the vectors, one is within ``distance // 2`` steps. A half is a cell of a grid. Each distinct fingerprint
enters its own cell of either half and, for one step, the cells above it in each dimension (a pair one step
apart meets in the upper one's cell). Fingerprints that meet are verified by their bits.

A cell gives a spanning forest, not all its pairs: its members are compared in blocks in memory, and of a
cell with more than ``LARGE`` members only those that agree in one of four quarters of the bits, which any
pair within three bits does. Copies share a fingerprint and never meet. Components of the links come from
rounds of neighbourhood contraction over tables in the shared folder.

Three bits of a fingerprint of shingles are few: of pairs whose sets of five-word shingles have a Jaccard similarity of 0.8, most
differ in more. ``similar_documents`` therefore joins the shingles themselves by prefixes, which is complete, and verifies the pairs.

Defined results: null counts as empty; a text without words has fingerprint zero and is linked like any
other; rows with a null id take part, and a component of null ids only has a null component_id; repeated
rows are separate rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from genoloom.llm import shared
from genoloom.llm.wordarrays import NOT_SPACE, Segment, mixed, segments

SHINGLE, SEED, DISTANCE, LARGE = 3, 42, 3, 2048
#: Shingles hashed at a time: their bits take 64 bytes each.
_BLOCK = 1 << 13
#: Of the similar documents: one document in so many is looked at for common shingles, of which the most common are kept; groups
#: whose pairs are all verified at once; rows of a larger one that are compared with all first; rows of a block of one; the rank
#: (the logarithm of the sampled documents) from which a shingle's rows are dealt to slices.
SAMPLED, HOT, MANY, PIVOTS, BLOCK, SLICED = 16, 2_000_000, 8, 4, 1024, 12


def _normalised(seg: Segment) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and their spans."""
    keep = np.zeros(len(seg.data) + 1, bool)
    word = NOT_SPACE[seg.data]
    keep[:-1] = word
    length = seg.ends - seg.starts
    ends = np.cumsum(length + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    starts = ends - length
    place = np.ones(len(out), bool)
    place[ends] = False
    out[place] = seg.data[word]
    return out.tobytes(), starts, ends


def fingerprints(seg: Segment, shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit fingerprint for each row."""
    from xxhash import xxh64_intdigest

    text, starts, ends = _normalised(seg)
    n = np.diff(seg.bounds)
    shingles = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    counts = np.zeros((seg.n, 64), np.int64)
    rows = np.repeat(np.arange(seg.n), shingles)
    first = seg.bounds[rows] + (np.arange(len(rows)) - (np.cumsum(shingles) - shingles)[rows])
    last = np.minimum(first + shingle - 1, seg.bounds[rows + 1] - 1)
    for k in range(0, len(rows), _BLOCK):
        r, a, b = rows[k : k + _BLOCK], starts[first[k : k + _BLOCK]], ends[last[k : k + _BLOCK]]
        h = np.fromiter((xxh64_intdigest(text[x:y], SEED) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(r))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        here, at = np.unique(r, return_index=True)
        counts[here] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    set_ = counts * 2 > shingles[:, None]
    return np.packbits(set_, axis=1).view(">u8").astype(np.uint64).ravel()


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """_rid, id, fp (the fingerprint as a long) for each row of ``docs``."""

    @shared.trims
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for seg in segments(b.column(2), NOT_SPACE):
                to = slice(seg.first, seg.first + seg.n)
                yield pa.RecordBatch.from_arrays([b.column(0)[to], b.column(1)[to], pa.array(fingerprints(seg, shingle).view(np.int64))], names=["_rid", "id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    docs = shared.numbered(docs)
    return docs.select(docs[shared.RID].alias("_rid"), docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"_rid long, id {kind}, fp long")


def popcounts(x: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in its segment's place."""
    return x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) for every cell that a fingerprint enters, of either half."""
    v, out, who = popcounts(fp), [], []
    low = np.uint64(0xFFFFFFFF)
    for half, shift in ((0, np.uint64(0)), (1, np.uint64(32))):
        own = (v >> shift) & low
        mark = np.uint64(half) << np.uint64(32)
        out.append(own | mark)
        who.append(fp)
        for j in range(16):
            two = np.uint64(2 * j)
            on = ((own >> two) & np.uint64(3)) < 2
            out.append((own[on] + (np.uint64(1) << two)) | mark)
            who.append(fp[on])
    return np.concatenate(out), np.concatenate(who)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= distance


def forest(fp: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that join what the links within ``distance`` join, fewer than there are members."""
    fp = np.unique(fp)
    parent = np.arange(len(fp))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []

    def join(own: np.ndarray):
        for k in range(0, len(own), 512):
            i, j = np.nonzero(_near(fp[own[k : k + 512]], fp[own[k:]], distance))
            for x, y in zip(own[k + i[i < j]].tolist(), own[k + j[i < j]].tolist(), strict=True):
                a, b = find(x), find(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(fp[x]), int(fp[y])))

    if len(fp) <= LARGE:
        join(np.arange(len(fp)))
        return out
    bands = distance + 1
    for k in range(bands):
        lo, hi = 64 * k // bands, 64 * (k + 1) // bands
        part = (fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order])) + 1
        for own in np.split(order, edges):
            if len(own) > 1:
                join(np.sort(own))
    return out


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(t, a, b): links between distinct fingerprints of the columns (t, fp) that connect all within ``distance`` of one table t."""
    if distance > 3:
        raise ValueError("two halves leave at most one step to either only up to a distance of 3")

    @shared.trims
    def enter(batches):
        import pyarrow as pa

        for b in batches:
            t, x = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for own in np.unique(t).tolist():
                fp = x[t == own]
                for k in range(0, len(fp), 4096):
                    c, f = cells(fp[k : k + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array((c | np.uint64(own << 33)).view(np.int64)), pa.array(f.view(np.int64))], names=["cell", "fp"])

    @shared.trims
    def meet(batches):
        cell = fp = np.zeros(0, np.int64)
        for b in batches:
            cell = np.concatenate([cell, b.column(0).to_numpy()])
            fp = np.concatenate([fp, b.column(1).to_numpy()])
            if len(cell) and cell[0] != cell[-1]:
                done = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
                yield _links_of(cell[:done], fp[:done], distance)
                cell, fp = cell[done:], fp[done:]
        yield _links_of(cell, fp, distance)

    entered = fps.select(F.col("t").cast("long"), "fp").mapInArrow(enter, "cell long, fp long")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entered.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(meet, "t long, a long, b long").distinct()


def _links_of(cell: np.ndarray, fp: np.ndarray, distance: int):
    """Of rows in order of their cells."""
    import pyarrow as pa

    u, t, a, b = fp.view(np.uint64), [], [], []
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(cell)))
    for n in range(2, 9):  # most cells are small: all those of one size at once
        at = first[size == n]
        for i in range(n):
            for j in range(i + 1, n):
                x, y = u[at + i], u[at + j]
                on = (np.bitwise_count(x ^ y) <= distance) & (x != y)
                t.append(cell[at[on]] >> 33)
                a.append(x[on])
                b.append(y[on])
    for k, n in zip(first[size > 8].tolist(), size[size > 8].tolist(), strict=True):
        if found := forest(u[k : k + n], distance):
            t.append(np.full(len(found), cell[k] >> 33))
            a.append(np.array([x for x, _ in found], np.uint64))
            b.append(np.array([y for _, y in found], np.uint64))
    t, a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (t, a, b))
    return pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["t", "a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the least node it can reach.

    Large-star and small-star rounds, each a pass of map-side aggregates and one join over the edges.
    """
    e = shared.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    old, before = None, e
    while True:
        # large star: neighbours above a node go to the least around it
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: those below a node, and the node, go to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        last, e = before, shared.written(e, "edges")
        shared.drop(last)
        before = e
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == old or now[0] == 0:
            break
        old = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def shingle_sets(seg: Segment, shingle: int) -> list[bytes]:
    """The sorted hashes of each row's distinct shingles; fewer words are one shingle."""
    h, out = seg.hashes(), []
    for a, b in zip(seg.bounds[:-1].tolist(), seg.bounds[1:].tolist(), strict=True):
        n = max(min(1, b - a), b - a - shingle + 1)
        x = np.zeros(n, np.uint64)
        for j in range(min(shingle, b - a)):
            x = mixed(x + h[a + j : a + j + n])
        out.append(np.unique(x).tobytes())
    return out


def ordered_shingles(seg: Segment, shingle: int, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the distinct shingles, each row's in the order of their keys: by ``rank`` where ``hot`` (sorted hashes) has
    them and else first, then by hash."""
    n = np.diff(seg.bounds)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    rows = np.repeat(np.arange(seg.n), count)
    first = seg.bounds[rows] + (np.arange(len(rows)) - (np.cumsum(count) - count)[rows])
    h, last, x = seg.hashes(), seg.bounds[rows + 1], np.zeros(len(rows), np.uint64)
    for j in range(shingle):
        on = first + j < last
        x[on] = mixed(x[on] + h[first[on] + j])
    key = x >> np.uint64(6)
    if len(hot) and len(x):
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        key |= np.where(hot[at] == key, rank[at], np.uint8(0)).astype(np.uint64) << np.uint64(58)
    order = np.lexsort((key, rows))
    rows, key = rows[order], key[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    return rows[new], key[new]


def _hot(base: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents have and ranks of how many, from one document in ``SAMPLED``. They only decide which shingles
    are looked at first; any order finds the same pairs."""

    @shared.trims
    def run(batches):
        import pyarrow as pa

        none = np.zeros(0, np.uint64)
        for b in batches:
            for seg in segments(b.column(0), NOT_SPACE):
                yield pa.RecordBatch.from_arrays([pa.array(ordered_shingles(seg, shingle, none, none)[1].view(np.int64))], names=["key"])

    few = base.filter(F.pmod(F.xxhash64("_rid"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "key long")
    found = few.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= 4).orderBy(F.desc("n")).limit(HOT).toArrow()
    key, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(key)
    return key[order], np.minimum(np.log2(n[order]), 63).astype(np.uint8)


def _runs(batches, columns: int):
    """Arrays of the columns of rows sorted by the first column, all rows of a key in one of the lists."""
    kept = None
    for b in batches:
        now = [b.column(i).to_numpy() for i in range(columns)]
        kept = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
        if len(kept[0]) and kept[0][0] != kept[0][-1]:
            done = int(np.searchsorted(kept[0], kept[0][-1]))
            yield [x[:done] for x in kept]
            kept = [x[done:] for x in kept]
    if kept is not None and len(kept[0]):
        yield kept


def _spans(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return first, np.diff(np.append(first, len(key)))


def _verified(base: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are as similar. Most others fall by 16 bits of each shingle, which may only find them too similar."""
    for bits in (16, 64):
        asked = shared.Listed(pairs.select(F.col("a").alias("_rid")).unionByName(pairs.select(F.col("b").alias("_rid"))))
        own = shared.written(base.mapInArrow(_sets(shingle, bits, asked), "_rid long, n int, s binary"), "shingles")
        x, y = (own.select(F.col("_rid").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}")) for c in "ab")
        full = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "sa", "sb")
        pairs = shared.written(full.mapInArrow(_similar(similarity, bits), "a long, b long"), "verified")
        shared.drop(own)
    return pairs


def _picked(b, keep: np.ndarray):
    import pyarrow as pa

    return b if keep.all() else b.filter(pa.array(keep))


def _sets(shingle: int, bits: int, asked: shared.Listed):
    @shared.trims
    def run(batches):
        import pyarrow as pa

        for b in batches:
            b = _picked(b, asked.has(b.column(0).to_numpy()))
            for seg in segments(b.column(1), NOT_SPACE):
                sets = shingle_sets(seg, shingle)
                n = [len(x) // 8 for x in sets]
                if bits < 64:
                    sets = [np.unique(np.frombuffer(x, np.uint64).astype(np.uint16)).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0)[seg.first : seg.first + seg.n], pa.array(n, pa.int32()), pa.array(sets, pa.binary())], names=["_rid", "n", "s"])

    return run


def _similar(similarity: float, bits: int):
    kind = np.dtype(f"u{bits // 8}")

    @shared.trims
    def run(batches):
        import pyarrow as pa

        for b in batches:
            on = []
            for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                x, y = np.frombuffer(x.as_py(), kind), np.frombuffer(y.as_py(), kind)
                # shingles of one row that are alike in these bits may all be shared
                both = len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y))
                on.append(both >= similarity * (n + m - both))
            on = pa.array(on, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(on), b.column(1).filter(on)], names=["a", "b"])

    return run


def similar_documents(docs: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, sliced: int = SLICED) -> DataFrame:
    """(a, b): links between rows (their numbers) of a Jaccard similarity of ``similarity`` or more, that connect all that are
    as similar.

    Of two such rows' shingles in any common order, the first ``n - ceil(similarity * n) + 1`` of either share one. Those are
    joined, rare shingles first in the order. Two rows that first meet at places ``i`` and ``j`` share ``min(n - i, m - j)`` shingles
    at most, so that rows of many shingles of their own meet nobody. A first round verifies small groups' pairs, and of each large
    group the pairs with the rows that have the least rare shingles; a second all pairs left whose rows the verified links do not
    connect yet. A shingle of very many documents (a rank of ``sliced`` at least) is dealt to slices that have first rows of
    their own, and all its rows also meet the first of all. Rows with the same shingles are proposed to the first of them.
    Documents without words are left out.
    """
    docs = shared.numbered(docs)
    base = docs.select(docs[shared.RID].alias("_rid"), docs[text_col].alias("text"))
    hot, rank = _hot(base, shingle)
    hot = base.sparkSession.sparkContext.broadcast((hot, rank))  # at most HOT shingles
    rank_of = F.shiftrightunsigned("key", 58)
    slice_ = F.expr(f"IF(shiftrightunsigned(key, 58) >= {sliced}, CAST(pmod(xxhash64(_rid), shiftleft(1L, CAST(shiftrightunsigned(key, 58) - {sliced - 1} AS INT))) AS INT), 0)")
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @shared.trims
    def whole(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for b in batches:
            for seg in segments(b.column(1), NOT_SPACE):
                same = [xxh3_64_intdigest(x) for x in shingle_sets(seg, shingle)]
                on = np.diff(seg.bounds) > 0
                yield pa.RecordBatch.from_arrays([b.column(0)[seg.first : seg.first + seg.n].filter(pa.array(on)), pa.array(np.array(same, np.uint64)[on].view(np.int64))], names=["_rid", "same"])

    @shared.trims
    def begin(batches):
        import pyarrow as pa

        for b in batches:
            b = _picked(b, ~copies.has(b.column(0).to_numpy()))
            for seg in segments(b.column(1), NOT_SPACE):
                rows, key = ordered_shingles(seg, shingle, *hot.value)
                size = np.bincount(rows, minlength=seg.n)
                pos = np.arange(len(rows)) - (np.cumsum(size) - size)[rows]
                on = pos <= (size - np.ceil(similarity * size - 1e-6).astype(np.int64))[rows]
                rid = b.column(0).to_numpy()[seg.first : seg.first + seg.n]
                rows = rows[on]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[on].view(np.int64), rid[rows], size[rows].astype(np.int32), pos[on].astype(np.int32))], names=["key", "_rid", "size", "pos"])

    @shared.trims
    def meet(batches):
        """Rows that aren't alone with their key, and how many there are; all of a slice."""
        import pyarrow as pa

        for cols in _runs(batches, 4):
            n = np.repeat(*(lambda x: (x, x))(_spans(cols[0])[1]))
            on = (n > 1) | (cols[0].view(np.uint64) >> np.uint64(58) >= sliced)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[on]) for x in cols), pa.array(n[on].astype(np.int64))], names=["key", "_rid", "size", "pos", "n"])

    @shared.trims
    def some(batches):
        for key, rid, size, pos in _runs(batches, 4):
            a, b = [], []
            first, n = _spans(key)
            for k in range(2, MANY + 1):
                at = first[n == k]
                for i in range(k):
                    for j in range(i + 1, k):
                        a.append(at + i)
                        b.append(at + j)
            for f, k in zip(first[n > MANY].tolist(), n[n > MANY].tolist(), strict=True):
                lead = f + np.lexsort((rid[f : f + k], pos[f : f + k]))[:PIVOTS]  # mostly the same for all keys of a group
                a.append(np.repeat(lead, k))
                b.append(np.tile(np.arange(f, f + k), len(lead)))
            if a:
                yield _pairs(rid, size, pos, np.concatenate(a), np.concatenate(b), similarity)

    @shared.trims
    def rest(batches):
        for key, rid, size, pos, group, home, i, j in _runs(batches, 8):
            for f, k in zip(*(x.tolist() for x in _spans(key)), strict=True):
                own = np.arange(f, f + k)
                if (group[own] == group[f]).all():
                    continue
                for lo, hi in set(zip(i[own].tolist(), j[own].tolist(), strict=True)):
                    mine = own[(i[own] == lo) & (j[own] == hi)]
                    left, right = mine[home[mine] == lo], mine[home[mine] == hi]
                    for at in range(0, len(left), 256):
                        x, y = np.nonzero(group[left[at : at + 256], None] != group[None, right])
                        yield _pairs(rid, size, pos, left[at + x], right[y], similarity)

    same = shared.written(base.mapInArrow(whole, "_rid long, same long"), "same")
    first = same.groupBy("same").agg(F.min("_rid").alias("first"), F.count("*").alias("n")).filter("n > 1")
    star = shared.written(same.join(first, "same").filter("_rid <> first").select(F.col("first").alias("a"), F.col("_rid").alias("b")), "stars")
    shared.drop(same)
    copies = shared.Listed(star.select("b"))
    met = base.mapInArrow(begin, "key long, _rid long, size int, pos int").repartition(parts, "key", slice_).sortWithinPartitions("key")
    met = shared.written(met.mapInArrow(meet, "key long, _rid long, size int, pos int, n long"), "met")
    dealt = met.select("key", "_rid", "size", "pos").repartition(parts, "key", slice_).sortWithinPartitions("key")
    pairs = dealt.mapInArrow(some, "a long, b long").unionByName(star)
    common = met.filter(rank_of >= sliced)
    heads = shared.written(common.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("pos", "_rid", "size")).alias("head")), "heads")
    if not heads.isEmpty():
        hub = common.drop("n").join(heads, "key").filter("_rid <> head._rid")
        hub = hub.filter(_may_be(F.col("size"), F.col("pos"), F.col("head.size"), F.col("head.pos"), similarity))
        pairs = pairs.unionByName(hub.select(F.least("_rid", "head._rid").alias("a"), F.greatest("_rid", "head._rid").alias("b")))
    pairs = shared.written(pairs.distinct(), "proposed")
    found = _verified(base, pairs, shingle, similarity)

    large = met.filter((F.col("n") > MANY) & (rank_of < sliced))  # of all others each pair was verified
    if not heads.isEmpty():
        large = large.unionByName(common.drop("n").join(heads.select("key", "n"), "key"))
    groups = shared.written(components(found), "groups")
    large = large.join(groups, large["_rid"] == groups["node"], "left").withColumn("group", F.coalesce("root", "_rid"))
    large = shared.written(large.select("key", "_rid", "size", "pos", "n", "group"), "large")
    shared.drop(met, heads)
    open_ = large.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo <> hi").select("key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = large.join(open_, "key", "left_semi").withColumn("home", F.pmod(F.xxhash64("_rid"), blocks).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.select("key", "_rid", "size", "pos", "group", "home", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"))
    large = large.repartition(parts, "key", "i", "j").sortWithinPartitions("key")
    more = shared.written(large.mapInArrow(rest, "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"), "proposed")
    shared.drop(pairs)
    return found.unionByName(_verified(base, more, shingle, similarity))


def _may_be(n, i, m, j, similarity: float):
    """Whether rows of ``n`` and ``m`` shingles that first share those at places ``i`` and ``j`` may be as similar."""
    least = F.least if isinstance(n, Column) else np.minimum
    return least(n - i, m - j) * (1 + similarity) >= similarity * (n + m) - 1e-6


def _pairs(rid: np.ndarray, size: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float):
    """Distinct pairs of rows that may be as similar by their numbers of shingles and the places where they meet, the lesser first.
    That they met before, at lesser places, lets pairs through there if not here."""
    import pyarrow as pa

    on = _may_be(size[a].astype(np.int64), pos[a], size[b].astype(np.int64), pos[b], similarity) & (rid[a] != rid[b])
    x, y = rid[a[on]], rid[b[on]]
    x, y = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(x) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row a document: _rid, doc_id, fingerprint, component_id, _group (the _rid of its component's first row)."""
    rows = shared.written(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    # nulls last, and repeated ids by their place
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("_rid").alias("rid"))
    each = shared.written(rows.groupBy("fp").agg(F.min(rank).alias("first")), "distinct")
    found = components(links(each.select(F.lit(0).alias("t"), "fp"), distance))
    each = each.join(found, each["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = each.groupBy("root").agg(F.min("first").alias("least"))
    each = each.join(least, "root").select("fp", "least")
    return rows.join(each, "fp").select("_rid", F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id"), F.col("least.rid").alias("_group"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, **how) -> DataFrame:
    """One row of each group, that with the least id (nulls last, then the first in the input), with all columns. A group is what is
    linked by ``near_duplicates`` or by ``similar_documents``."""
    docs = shared.numbered(docs)
    with shared.scope():
        with shared.scope():
            rows = shared.kept(shared.written(near_duplicates(docs, id_col, text_col, **how).select("_rid", F.col(id_col).alias("_id"), "_group"), "near"))
        stars = rows.filter("_rid <> _group").select(F.col("_group").alias("a"), F.col("_rid").alias("b"))
        with shared.scope():
            similar = shared.kept(shared.written(similar_documents(docs, text_col, shingle, similarity), "similar"))
        found = shared.written(components(stars.unionByName(similar)), "groups")
        ids = rows.select(F.col("_rid").alias("node"), F.col("_id").alias("id"))
        best = found.join(ids, "node").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("least"))
        lost = found.join(best, "root").filter("node <> least.node").select(F.col("node").alias(shared.RID))
        lost = shared.kept(shared.written(lost, "lost"))
    return docs.join(lost, shared.RID, "left_anti").drop(shared.RID)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("_rid", "_group")
