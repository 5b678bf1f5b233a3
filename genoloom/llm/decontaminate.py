"""Benchmark decontamination by Wu-Manber search for many patterns at once.

The alphabet is words. A pattern is a window of ``WINDOW`` consecutive words of a benchmark item (a shorter
item is one pattern, searched with others of its length). A table of shifts, addressed by a hash of blocks
of two words, tells how far the window may move; where it may not, the hash of the window's last block
selects the patterns to try, and they are confirmed by comparing bytes. Documents are cut into short lanes
which all move at once in numpy.

Tables are built from at most ``BLOCK_BYTES`` of benchmark text; a larger benchmark is searched in as many blocks,
each over all documents, and the hits are united. Long items are cut into pieces of ``PIECE`` words that overlap
by a window, so that blocks stay near their bound. A block's tables take 13 times its text, and 40 times while they are built
(0.4 GB, 2 s for the bound); each worker builds them once.

Defined results: null text has no words and never matches; items without words match nothing; an item whose
id is null marks words but is listed nowhere; repeated items with one id count once; empty tables give empty or
clean results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from genoloom.llm import shared
from genoloom.llm.wordarrays import ALNUM, Segment, mixed, segments

WINDOW, LANE, BLOCK_BYTES, PIECE = 10, 128, 8 << 20, 1 << 14
_K = np.uint64(0x9DDFEA08EB382D69)


class Patterns:
    """Patterns of one length, and their tables. A pattern is a place in the benchmark's words; equal ones are one."""

    def __init__(self, length: int, seg: Segment, h: np.ndarray, places: np.ndarray, owners: np.ndarray, names: np.ndarray):
        self.length, self.block, self.seg, self.h, self.names = length, min(2, length), seg, h, names
        whole = h[places].copy()
        for q in range(1, length):
            whole = mixed(whole * _K + h[places + q])
        order = np.lexsort((owners, whole))
        places, owners, whole = places[order], owners[order], whole[order]
        new = np.append(True, whole[1:] != whole[:-1])
        # patterns whose hash meets that of another stay apart
        again = np.flatnonzero(~new)
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[again]
        new[again[[not self._same(places[i], places[j]) for i, j in zip(again.tolist(), first.tolist(), strict=True)]]] = True
        starts = np.flatnonzero(new)
        self.places, ends = places[starts], self._hash(h, places[starts] + length - 1)
        order = np.argsort(ends, kind="stable")
        #: By suffix: the patterns. By pattern: its items.
        self.suffixes, first = np.unique(ends[order], return_index=True)
        self.first, self.places = np.append(first, len(order)), self.places[order]
        self.item_from, self.item_to, self.owners = starts[order], np.append(starts[1:], len(new))[order], owners
        # at most as many blocks as words
        self.bits = np.uint64(64 - max(12, int(len(h)).bit_length() + 2))
        self.shift = np.full(1 << (64 - int(self.bits)), length - self.block + 1, np.uint8)
        for q in range(self.block - 1, length):
            np.minimum.at(self.shift, self._hash(h, self.places + q) >> self.bits, length - 1 - q)

    def _hash(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the blocks that end at these words."""
        return h[ends] if self.block == 1 else mixed(h[ends - 1] * _K + h[ends])

    def _same(self, p: int, q: int) -> bool:
        return _words(self.seg, p, self.length) == _words(self.seg, q, self.length)

    def items(self, k: int) -> list:
        """Ids of a pattern's items, as strings."""
        own = np.unique(self.owners[self.item_from[k] : self.item_to[k]])
        return [x for x in self.names[own] if x is not None]

    def search(self, h: np.ndarray, bounds: np.ndarray):
        """Places, in ``h``, where the last block of a pattern ends a window inside one document."""
        at = [np.arange(a, b - self.length + 1, LANE) for a, b in zip(bounds, bounds[1:], strict=False) if b - a >= self.length]
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ends = np.concatenate([np.minimum(x + LANE, b - self.length + 1) for x, b in zip(at, bounds[1:][np.diff(bounds) >= self.length], strict=True)])
        at, places, hashes = np.concatenate(at), [], []
        while len(at):
            block = self._hash(h, at + (self.length - 1))
            move = self.shift[block >> self.bits]
            if len(hit := np.flatnonzero(move == 0)):
                places.append(at[hit])
                hashes.append(block[hit])
            at = at + np.maximum(move, 1)
            on = at < ends
            at, ends = at[on], ends[on]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(places), np.concatenate(hashes)

    def occurrences(self, seg: Segment, h: np.ndarray):
        """(place, number of the pattern) for each occurrence, confirmed by its bytes."""
        places, hashes = self.search(h, seg.bounds)
        k = np.searchsorted(self.suffixes, hashes)
        k[k == len(self.suffixes)] = 0
        on = self.suffixes[k] == hashes
        span = np.arange(self.length)
        for p, s in zip(places[on].tolist(), k[on].tolist(), strict=True):
            a, b = self.first[s], self.first[s + 1]
            for j in (np.flatnonzero((self.h[self.places[a:b, None] + span] == h[p : p + self.length]).all(axis=1)) + a).tolist():
                if _words(seg, p, self.length) == _words(self.seg, int(self.places[j]), self.length):
                    yield p, j


def _words(seg: Segment, p: int, n: int) -> bytes:
    return b" ".join(seg.data[x:y].tobytes() for x, y in zip(seg.starts[p : p + n], seg.ends[p : p + n], strict=True))


def compiled(rows: list[tuple], window: int = WINDOW) -> list[Patterns]:
    """Tables of (item_id, text) rows, one for each length of patterns."""
    import pyarrow as pa

    if not rows:
        return []
    seg = next(segments(pa.array([t or "" for _, t in rows], pa.large_string()), ALNUM, 1 << 62))
    h, count = seg.hashes(), np.diff(seg.bounds)
    names, owner = np.unique(["" if i is None else str(i) for i, _ in rows], return_inverse=True)
    none = np.array([i is None for i, _ in rows])
    names, owner = np.append(names.astype(object), None), np.where(none, len(names), owner)
    length = np.minimum(count, window)
    out = []
    for n in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == n)
        times = count[own] - n + 1
        places = np.repeat(seg.bounds[own], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        out.append(Patterns(n, seg, h, places, np.repeat(owner[own], times), names))
    return out


_tables: dict[str, list[Patterns]] = {}


def tables_of(key: str, rows: list[tuple], window: int) -> list[Patterns]:
    """Built once a worker; the tables of another block go."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = compiled(rows, window)
    return _tables[key]


def pieces(items: DataFrame, window: int, most: int = PIECE) -> DataFrame:
    """(item, text) with long items cut into overlapping pieces that have all their windows."""

    @shared.trims
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for seg in segments(b.column(1), ALNUM):
                ids, texts = [], []
                for r in range(seg.n):
                    x, y = int(seg.bounds[r]), int(seg.bounds[r + 1])
                    for k in range(x, max(x + 1, y - window + 1), most):
                        if x < y:
                            ids.append(b.column(0)[seg.first + r].as_py())
                            texts.append(seg.data[seg.starts[k] : seg.ends[min(y, k + most + window - 1) - 1]].tobytes().decode())
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(texts, pa.string())], names=["item", "text"])

    return items.mapInArrow(run, f"item {items.schema['item'].dataType.simpleString()}, text string")


def hits(seg: Segment, tables: list[Patterns]) -> list[tuple[set, list]]:
    """For each row: its items, and the spans of words that are hit, from the row's first word."""
    h, out = seg.hashes(), [(set(), []) for _ in range(seg.n)]
    for t in tables:
        for p, k in t.occurrences(seg, h):
            r = int(np.searchsorted(seg.bounds, p, "right")) - 1
            out[r][0].update(t.items(k))
            out[r][1].append((p - int(seg.bounds[r]), t.length))
    return out


def covered(spans: list) -> int:
    n = last = 0
    for a, length in sorted(spans):
        n += max(0, a + length - max(a, last))
        last = max(last, a + length)
    return n


def _sha(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> DataFrame:
    """One row a document: _rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_col].alias("item"), benchmark[item_text_col].alias("text"))
    items = shared.written(pieces(items, window), "pieces")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    docs = shared.numbered(docs)
    slim = docs.select(docs[shared.RID].alias("_rid"), docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    if blocks == 1:
        # at most block_bytes of text, as measured above
        tables, key = spark.sparkContext.broadcast([tuple(r) for r in items.collect()]), uuid.uuid4().hex

        def search(batches):
            import pyarrow as pa

            own = tables_of(key, tables.value, window)
            clean = _sha(())
            for b in batches:
                for seg in segments(b.column(2), ALNUM):
                    found = hits(seg, own)
                    to = slice(seg.first, seg.first + seg.n)
                    n_hit = [covered(x) if x else 0 for _, x in found]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0)[to], b.column(1)[to], pa.array(np.diff(seg.bounds), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for i, _ in found], pa.int64()), pa.array([_sha(i) if i else clean for i, _ in found], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
                        names=["_rid", "id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                    )

        out = slim.mapInArrow(search, f"_rid long, id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
        return out.withColumnRenamed("id", id_col)

    parts = []
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        tables, key = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()]), uuid.uuid4().hex

        def spans(batches, tables=tables, key=key):
            import pyarrow as pa

            own = tables_of(key, tables.value, window)
            for b in batches:
                for seg in segments(b.column(2), ALNUM):
                    rows = [(b.column(0)[seg.first + r].as_py(), sorted(i), [list(s) for s in x]) for r, (i, x) in enumerate(hits(seg, own)) if x]
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64()))))], names=["_rid", "items", "spans"])

        parts.append(shared.written(slim.mapInArrow(spans, "_rid long, items array<string>, spans array<array<long>>"), "hits"))
    all_hits = parts[0]
    for p in parts[1:]:
        all_hits = all_hits.unionByName(p)
    one = all_hits.select("_rid", F.explode("spans").alias("s")).select("_rid", F.col("s")[0].alias("a"), (F.col("s")[0] + F.col("s")[1]).alias("b")).distinct()
    w = Window.partitionBy("_rid").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("last", F.coalesce(F.max("b").over(w), F.lit(0)))
    one = one.groupBy("_rid").agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", "last"))).alias("n_hit"))
    ids = all_hits.groupBy("_rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("ids"))

    @shared.trims
    def count(batches):
        import pyarrow as pa

        for b in batches:
            for seg in segments(b.column(2), ALNUM):
                to = slice(seg.first, seg.first + seg.n)
                yield pa.RecordBatch.from_arrays([b.column(0)[to], b.column(1)[to], pa.array(np.diff(seg.bounds), pa.int64())], names=["_rid", "id", "n_words"])

    out = slim.mapInArrow(count, f"_rid long, id {kind}, n_words long").join(one.join(ids, "_rid", "left"), "_rid", "left")
    none = F.array().cast("array<string>")
    return out.select("_rid", F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("ids", none)).cast("long").alias("n_items"), F.sha2(F.array_join(F.coalesce("ids", none), ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    docs = shared.numbered(docs)
    with shared.scope():
        hit = contamination(docs, benchmark, id_col, text_col, **how).filter("contaminated").select(F.col("_rid").alias(shared.RID))
        hit = shared.kept(shared.written(hit, "hit"))
    return docs.join(hit, shared.RID, "left_anti").drop(shared.RID)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("_rid")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS win
      FROM b, LATERAL (SELECT unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i) WHERE len(words) > 0),
v AS (SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS win
      FROM w, (SELECT DISTINCT n FROM p), LATERAL (SELECT unnest(range(1, len(words) - n + 2)) AS i)),
o AS (SELECT v.doc_id, v.i, v.n, p.item_id FROM v JOIN p ON v.n = p.n AND v.win = p.win),
h AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM o) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN t ON w.doc_id = t.doc_id
"""
