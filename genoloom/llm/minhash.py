"""MinHash near-dedup with circulant signatures, exact linking at a Jaccard similarity.

Two permutations make all coordinates: the first places a shingle among ``PLACES`` places (a mixing hash, taken modulo
``PLACES``), the second is a table of the places' ranks. Coordinate ``k`` of a set is the least rank found ``k`` places
after any of its shingles, which is the second permutation shifted by ``k``: the coordinates of a shingle stand in a row in the table and
are read at once.

Rows with equal sets are one row from the start, by 128 bits of the sorted shingles. ``BANDS`` bands of ``ROWS``
coordinates each are hashed to keys; at a similarity of 0.8 a pair has no band in common with a chance of (1 - 0.8^5)^51 < 2e-9.
Pairs are verified on full sets of 64-bit shingle hashes, in three rounds:

1. each row with the least row that any of its bands has (one pair a row);
2. with the least rows of its other bands, as far as the links found don't join them yet;
3. in bands whose rows are still of several components, all pairs of different components of which one is not of the band's
   largest. Rows of a band are dealt to blocks of about ``BLOCK`` shingles, so that a band of any size is spread over tasks. A task indexes its
   block by 16 bits of each shingle and counts what each row shares with all of the block at once; that count is never too small, and only
   pairs that it lets be similar leave the task.

A group of copies, near or exact, costs a pair a row, not all its pairs.

Defined results: null counts as empty; a text without words has an empty set and is linked with nothing; fewer words than a shingle
has are one shingle; rows with a null id take part, and a component of null ids only has a null component_id; repeated
rows are separate rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, functions as F

from genoloom.llm import shared
from genoloom.llm.simhash import components
from genoloom.llm.wordarrays import NOT_SPACE, Segment, mixed, segments

SHINGLE, PERCENT = 2, 80
#: A larger set than ``PLACES`` only meets more rows than it must.
ROWS, BANDS, PLACES = 5, 51, 1 << 20
COORDINATES = ROWS * BANDS
#: Shingles of a block; those whose coordinates are held at once.
BLOCK, _CHUNK = 1 << 20, 256


@functools.lru_cache(1)
def ranks() -> np.ndarray:
    """The second permutation, with its begin once more at the end: rows of ``COORDINATES`` ranks from any place on."""
    order = np.argsort(mixed(np.arange(PLACES, dtype=np.uint64) + np.uint64(0x5DEECE66D)), kind="stable")
    rank = np.empty(PLACES, np.uint32)
    rank[order] = np.arange(PLACES, dtype=np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[: COORDINATES - 1]]), COORDINATES)


def sets(seg: Segment, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, in the order of rows and hashes."""
    n = np.diff(seg.bounds)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    rows = np.repeat(np.arange(seg.n), count)
    first = seg.bounds[rows] + (np.arange(len(rows)) - (np.cumsum(count) - count)[rows])
    h, last, x = seg.hashes(), seg.bounds[rows + 1], np.zeros(len(rows), np.uint64)
    for j in range(shingle):
        on = first + j < last
        x[on] = mixed(x[on] + h[first[on] + j])
    order = np.lexsort((x, rows))
    rows, x = rows[order], x[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (x[1:] != x[:-1])) if len(x) else np.zeros(0, bool)
    return rows[new], x[new]


def signatures(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The coordinates of each of ``n`` rows; rows without shingles have the greatest number everywhere."""
    out = np.full((n, COORDINATES), np.iinfo(np.uint32).max, np.uint32)
    table, place = ranks(), (mixed(hashes ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(PLACES)).astype(np.int64)
    for k in range(0, len(rows), _CHUNK):
        r, found = rows[k : k + _CHUNK], table[place[k : k + _CHUNK]]
        at = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        own = r[at]
        out[own] = np.minimum(out[own], np.minimum.reduceat(found, at, axis=0))
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A key for each band of each row."""
    part = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    x = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), part.shape[:2])
    for j in range(ROWS):
        x = mixed(x + part[:, :, j])
    return x


def _digest(rows: np.ndarray, hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """Two numbers of each row's set: sums of differently mixed shingles, mixed with their number."""
    size, out = np.bincount(rows, minlength=n), []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(salt)), dtype=np.uint64)])
        to = np.cumsum(size)
        out.append(mixed(total[to] - total[to - size] + size.astype(np.uint64)))
    return out


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """_rid, id, n (of the set), d1 and d2 (its digest) and bands for each row; an empty set has no bands."""

    @shared.trims
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for seg in segments(b.column(2), NOT_SPACE):
                rows, h = sets(seg, shingle)
                size, (d1, d2) = np.bincount(rows, minlength=seg.n), _digest(rows, h, seg.n)
                keys = bands(signatures(rows, h, seg.n)).view(np.int64)[size > 0]
                places = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))])
                to = slice(seg.first, seg.first + seg.n)
                made = [pa.array(x) for x in (size.astype(np.int64), d1.view(np.int64), d2.view(np.int64))]
                lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0)[to], b.column(1)[to], *made, lists], names=["_rid", "id", "n", "d1", "d2", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    docs = shared.numbered(docs)
    return docs.select(docs[shared.RID].alias("_rid"), docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"_rid long, id {kind}, n long, d1 long, d2 long, bands array<long>")


def _sets_of(base: DataFrame, rids: DataFrame, shingle: int, bits: int = 64) -> DataFrame:
    """(_rid, s): the sorted sets of the listed rows, or distinct low bits of them. Texts are read again and picked by lists of numbers."""
    asked = shared.Listed(rids)

    @shared.trims
    def run(batches):
        import pyarrow as pa

        for b in batches:
            on = asked.has(b.column(0).to_numpy())
            b = b if on.all() else b.filter(pa.array(on))
            for seg in segments(b.column(1), NOT_SPACE):
                rows, h = sets(seg, shingle)
                if bits < 64:
                    both = np.unique(rows.astype(np.int64) << bits | (h & np.uint64((1 << bits) - 1)).astype(np.int64))
                    rows, h = both >> bits, (both & ((1 << bits) - 1)).astype(f"u{bits // 8}")
                to = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=seg.n))]) * h.itemsize
                own = pa.Array.from_buffers(pa.large_binary(), seg.n, [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([b.column(0)[seg.first : seg.first + seg.n], own.cast(pa.binary())], names=["_rid", "s"])

    return shared.written(base.mapInArrow(run, "_rid long, s binary"), "sets")


def _verified(base: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are as similar. Pairs meet their sets by joins, whose hot keys Spark splits."""

    @shared.trims
    def alike(batches):
        import pyarrow as pa

        for b in batches:
            on = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                on.append(100 * both >= percent * (len(x) + len(y) - both))
            on = pa.array(on, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(on), b.column(1).filter(on)], names=["a", "b"])

    own = _sets_of(base, pairs.select(F.col("a").alias("_rid")).unionByName(pairs.select(F.col("b").alias("_rid"))), shingle)
    x, y = (own.select(F.col("_rid").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    found = shared.written(pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(alike, "a long, b long"), "verified")
    shared.drop(own)
    return found


def _sized(n, m, percent: int):
    """Whether sets of ``n`` and ``m`` may be as similar."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def links(docs: DataFrame, rows: DataFrame, text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between the first rows of equal sets that connect all that are as similar.

    docs are numbered, and rows what ``signed`` made of them.
    """
    base = docs.select(docs[shared.RID].alias("_rid"), docs[text_col].alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("_rid").alias("_rid"))
    keyed = rows.join(one.select("_rid"), "_rid").select("_rid", F.col("n").cast("int").alias("n"), "bands")
    met = keyed.select("_rid", "n", F.explode("bands").alias("key"))
    heads = shared.written(met.groupBy("key").agg(F.min(F.struct("_rid", "n")).alias("head"), F.count("*").alias("rows")).filter("rows > 1"), "heads")
    met = shared.written(met.join(heads.select("key", "head"), "key"), "met")

    led = met.filter("_rid <> head._rid").filter(_sized(F.col("n"), F.col("head.n"), percent))
    led = shared.written(led.groupBy(F.col("head._rid").alias("a"), F.col("_rid").alias("b")).agg(F.count("*").alias("times")), "led")
    least = led.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = _verified(base, least, shingle, percent)

    def joined(links_: DataFrame) -> DataFrame:
        return shared.written(components(links_).select(F.col("node").alias("_rid"), F.col("root").alias("group")), "groups")

    def group(df: DataFrame, groups: DataFrame, c: str, to: str) -> DataFrame:
        return df.join(groups.select(F.col("_rid").alias(c), F.col("group").alias("_g")), c, "left").withColumn(to, F.coalesce("_g", c)).drop("_g")

    groups = joined(found)
    more = group(group(led.join(least, ["a", "b"], "left_anti"), groups, "a", "ga"), groups, "b", "gb").filter("ga <> gb").select("a", "b")
    more = _verified(base, shared.written(more, "more"), shingle, percent)
    found = shared.written(found.unionByName(more), "found")

    groups = joined(found)
    others = met.filter("_rid <> head._rid").select("key", "_rid", "n")  # each was compared with the head
    open_ = shared.written(group(others, groups, "_rid", "group"), "open")
    counts = open_.groupBy("key", "group").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    large = counts.groupBy("key").agg(F.max(F.struct("rows", "group")).alias("most"), F.count("*").alias("groups"), F.sum("shingles").alias("shingles")).filter("groups > 1")
    large = large.select("key", F.col("most.group").alias("most"), F.ceil(F.col("shingles") / BLOCK).cast("int").alias("blocks"))
    rest = shared.written(open_.join(large, "key").withColumn("minor", F.expr("group <> most")).drop("most"), "rest")
    own = _sets_of(base, rest.select("_rid"), shingle, 16)
    full = rest.join(own, "_rid")
    right = full.select("key", F.expr("CAST(pmod(xxhash64(_rid), blocks) AS INT)").alias("block"), F.lit(1).alias("side"), "_rid", "n", "group", "minor", "s")
    left = full.filter("minor").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(2).alias("side"), "_rid", "n", "group", "minor", "s")
    dealt = left.unionByName(right).repartition(parts, "key", "block").sortWithinPartitions("key", "block", "side")
    last = shared.written(dealt.mapInArrow(_shared_shingles(percent), "a long, b long").distinct(), "rest_pairs")
    shared.drop(own)
    return found.unionByName(_verified(base, last, shingle, percent))


def _shared_shingles(percent: int):
    """For rows in the order of key, block and side: pairs of a row of the second side and one of the first, of different groups, that may be as
    similar. A pair of two minor rows is met from either side and told once."""

    @shared.trims
    def run(batches):
        import pyarrow as pa

        held, block = None, None
        for b in batches:
            key, place, side, rid, n, group, minor = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (side[1:] != side[:-1]))).tolist() + [len(key)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if held != (key[lo], place[lo]):
                    held, block = (key[lo], place[lo]), _Block()
                own = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(7)[lo:hi]]
                if side[lo] == 1:
                    block.add(rid[lo:hi], n[lo:hi], group[lo:hi], minor[lo:hi], own)
                    continue
                for k, x in enumerate(own, lo):
                    found = block.like(int(rid[k]), int(n[k]), int(group[k]), x, percent)
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(found, rid[k])), pa.array(np.maximum(found, rid[k]))], names=["a", "b"])

    return run


class _Block:
    """Rows with an index from 16 bits of a shingle to those that have it."""

    def __init__(self):
        self.parts, self.index = [], None

    def add(self, rid, n, group, minor, own: list[np.ndarray]) -> None:
        self.parts.append((rid, n, group, minor, np.array([len(x) for x in own]), np.concatenate(own)))
        self.index = None

    def like(self, rid: int, n: int, group: int, x: np.ndarray, percent: int) -> np.ndarray:
        if not self.parts:
            return np.zeros(0, np.int64)
        if self.index is None:
            cols = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            self.rid, self.n, self.group, self.minor, self.size = cols[:5]
            order = np.argsort(cols[5], kind="stable")
            self.rows = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)[order]
            self.index = np.searchsorted(cols[5][order], np.arange(65537))
        first, count = self.index[x], self.index[x.astype(np.int64) + 1] - self.index[x]
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        both = np.bincount(self.rows[at], minlength=len(self.size)) + np.minimum(n - len(x), self.n - self.size)
        on = (100 * both >= percent * (n + self.n - both)) & (self.group != group) & (~self.minor | (self.rid > rid))
        return self.rid[on]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row a document: _rid, the id, n_shingles, component_id, kept, _group (the _rid of its component's first row)."""
    docs = shared.numbered(docs)
    with shared.scope():
        rows = shared.written(signed(docs, id_col, text_col, shingle), "signatures")
        found = shared.written(components(links(docs, rows, text_col, shingle, percent)), "groups")
        # nulls last, and repeated ids by their place
        rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("_rid").alias("rid"))
        each = shared.written(rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("_rid").alias("node"), F.min(rank).alias("first")), "distinct")
        each = each.join(found, "node", "left").select("d1", "d2", "first", F.coalesce("root", "node").alias("root"))
        least = each.groupBy("root").agg(F.min("first").alias("least"))
        each = each.join(least, "root").select("d1", "d2", "least")
        out = rows.filter("n > 0").join(each, ["d1", "d2"]).select("_rid", "id", "n", "least")
        alone = rows.filter("n = 0").select("_rid", "id", "n", F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("_rid").alias("rid")).alias("least"))
        out = out.unionByName(alone)
        out = out.select("_rid", F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), F.col("id").eqNullSafe(F.col("least.id")).alias("kept"), F.col("least.rid").alias("_group"))
        return shared.kept(shared.written(out, "near"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component, that with the least id (nulls last, then the first in the input), with all columns."""
    docs = shared.numbered(docs)
    lost = near_duplicates(docs, id_col, text_col, **how).filter("_rid <> _group").select(F.col("_rid").alias(shared.RID))
    return docs.join(lost, shared.RID, "left_anti").drop(shared.RID)


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("_rid", "_group")
