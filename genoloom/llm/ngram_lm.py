"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counting. Workers hash the words of their texts in numpy and count them before anything is sent; counts go
to shards of the hash space as packed arrays, one row a worker and shard, are added up there, and written
as sorted hash arrays. There is a shard for about ``SHARD_BYTES`` of text, and each is a task's alone, so that a task's memory does
not grow with the corpus. A word's place in the sorted arrays of all shards is its id. Pairs of ids are counted
and stored in the same way, sharded by a hash of the pair, so that a frequent word is no heavier than
others. A third pass gives each id, as a context, its total and the number of followers seen once, twice and
more often, and, as a word, the number of contexts it follows.

Scoring. Workers map the arrays of the shards they need into memory, at most ``MAPS`` at a time (of a store without local paths, a copy
whose name is removed at once, so that it ends with the worker), and look up the distinct words and pairs of a batch at once.

The model: p(w|v) = max(c(vw) - D(c), 0) / c(v) + g(v) p(w), with p(w) of the same form over continuation
counts and 1/(V+1) below it, which leaves a share for words never seen. Texts begin after a context of
their own and end with an end token, which is predicted like a word. D1, D2 and D3+ are the usual
estimates from the counts of counts, kept between a small share and the count.

Defined results: a null text counts as empty and has the end token alone; a row with a null id is not held out
and is learned from; without training rows all probabilities are those of an unseen word; an empty table gives an
empty result; repeated rows are separate rows, and count as often as they occur; other columns are not read. Pairs are of two ids of 32
bits: ``train`` refuses a corpus of more distinct words.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, functions as F

from genoloom.llm import shared
from genoloom.llm.wordarrays import NOT_SPACE, mixed, segments

FOLDS, HELD_OUT, RANGE, SCORED_BYTES, PENDING, SHARD_BYTES, MAPS = 7, 2, 1 << 17, 2 << 20, 1 << 18, 32 << 20, 4096
#: So that unseen words keep a share in any corpus.
LEAST_DISCOUNT = 0.05
END = np.uint64(0x454E44)  # a word with this hash clashes like any other two
#: From a hash function to the one that checks it.
CHECK = 1 << 20


# Packed arrays


def planes(x: np.ndarray) -> bytes:
    """Bytes by significance, so that compression finds the zeros."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, np.uint64), dtype=np.uint64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if not len(x):
        return []
    edges = np.flatnonzero(x[1:] != x[:-1]) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(x)], strict=True))


class Words:
    """Counts words by their hash and a second hash, so that two words of one hash stay two and are found when shards are added up."""

    def __init__(self, shard_of):
        self.shard_of, self.pending, self.size = shard_of, [], 0
        self.rows = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]

    def add(self, keys: np.ndarray, checks: np.ndarray):
        self.pending.append((keys, checks))
        self.size += len(keys)
        if self.size >= PENDING:
            self.merge()
        return len(self.rows[0]) >= 2 * PENDING

    def merge(self):
        new = [np.concatenate([x[j] for x in self.pending]) if self.pending else np.zeros(0, np.uint64) for j in (0, 1)]
        self.rows = list(told_apart(*(np.concatenate([a, b]) for a, b in zip(self.rows, [*new, np.ones(len(new[0]), np.int64)], strict=True))))
        self.pending, self.size = [], 0

    def blobs(self):
        self.merge()
        shard = self.shard_of(self.rows[0])
        order = np.argsort(shard, kind="stable")
        (keys, checks, counts), shard = (x[order] for x in self.rows), shard[order]
        self.rows = [x[:0] for x in self.rows]
        for a, b in runs(shard):
            yield int(shard[a]), pack(keys[a:b]), planes(counts[a:b].astype(np.uint64)) + planes(checks[a:b])


def told_apart(keys: np.ndarray, checks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs of key and check, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, checks, counts = keys[order], checks[order], counts[order]
    same = keys[1:] == keys[:-1]
    if (same & (checks[1:] != checks[:-1])).any():  # hardly ever
        order = np.lexsort((checks, keys))
        keys, checks, counts = keys[order], checks[order], counts[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], checks[first], np.add.reduceat(counts, first) if len(first) else counts


class Tally:
    """Counts keys; ``blobs`` gives what there is by shard."""

    def __init__(self, shard_of):
        self.shard_of, self.pending, self.size = shard_of, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray):
        self.pending.append(keys)
        self.size += len(keys)
        if self.size >= PENDING:
            self.merge()
        return len(self.keys) >= 2 * PENDING

    def merge(self):
        new = np.sort(np.concatenate(self.pending)) if self.pending else np.zeros(0, np.uint64)
        first = np.flatnonzero(np.append(True, new[1:] != new[:-1])) if len(new) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(new)))
        self.keys, self.counts = added(np.concatenate([self.keys, new[first]]), np.concatenate([self.counts, counts]))
        self.pending, self.size = [], 0

    def blobs(self):
        self.merge()
        shard = self.shard_of(self.keys)
        order = np.argsort(shard, kind="stable")
        keys, counts, shard = self.keys[order], self.counts[order], shard[order]
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for a, b in runs(shard):
            yield int(shard[a]), pack(keys[a:b]), planes(counts[a:b].astype(np.uint64))


BLOBS = "shard int, keys binary, counts binary"


def _batch(rows, names, types):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)


def _blob_batches(rows):
    """Batches of about 8 MB, as one blob may be large."""
    import pyarrow as pa

    own, size = [], 0
    for r in rows:
        own.append(r)
        size += len(r[1]) + len(r[2])
        if size > 8 << 20:
            yield _batch(own, ("shard", "keys", "counts"), (pa.int32(), pa.binary(), pa.binary()))
            own, size = [], 0
    if own:
        yield _batch(own, ("shard", "keys", "counts"), (pa.int32(), pa.binary(), pa.binary()))


def _by_shard(batches):
    """(shard, [its rows]) of batches in order of their first column."""
    shard, rows = None, []
    for b in batches:
        for i in range(b.num_rows):
            s = b.column(0)[i].as_py()
            if s != shard:
                if rows:
                    yield shard, rows
                shard, rows = s, []
            rows.append([b.column(j)[i].as_py() for j in range(1, b.num_columns)])
    if rows:
        yield shard, rows


# Files


def save(at: str, *arrays: np.ndarray) -> None:
    """Arrays one after the other. A task that runs again writes the same under the same name."""
    system, path = shared.filesystem(at)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a))
    system.move(part, path)


_maps: dict[str, np.ndarray] = {}


def mapped(at: str) -> np.ndarray:
    """The bytes of a file, mapped into memory."""
    if at not in _maps:
        import os
        import tempfile

        from pyarrow import fs

        system, path = shared.filesystem(at)
        if not isinstance(system, fs.LocalFileSystem):
            own, name = tempfile.mkstemp(prefix="model-")
            with system.open_input_stream(path) as src, open(own, "wb") as dst:
                while block := src.read(1 << 22):
                    dst.write(block)
            path = name
        if len(_maps) >= MAPS:
            del _maps[next(iter(_maps))]
        _maps[at] = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        if not isinstance(system, fs.LocalFileSystem):
            os.unlink(path)
    return _maps[at]


class Shards:
    """Sorted keys and their counts, in files by shard: 8 bytes a key, then 8 bytes a count."""

    def __init__(self, at: str, sizes: list[int], shard_of):
        self.at, self.sizes, self.shard_of = at, sizes, shard_of
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def part(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        raw = mapped(f"{self.at}-{s}").view(np.uint64)
        return raw[: self.sizes[s]], raw[self.sizes[s] :]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place or -1, count or 0) of sorted keys."""
        place, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        shard = self.shard_of(keys)
        order = np.argsort(shard, kind="stable")
        for a, b in runs(shard[order]):
            own, s = order[a:b], int(shard[order[a]])
            if not self.sizes[s]:
                continue
            k, c = self.part(s)
            i = np.searchsorted(k, keys[own])
            i[i == len(k)] = 0
            on = k[i] == keys[own]
            place[own[on]] = i[on] + self.offsets[s]
            count[own[on]] = c[i[on]].astype(np.int64)
        return place, count


# Counting


def _top(bits: int):
    return lambda keys: (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _hashed(bits: int):
    top = _top(bits)
    return lambda keys: top(mixed(keys))


def _tokens(seg, ids: np.ndarray, end: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids with an end after each row, contexts, first token of each row)."""
    first = seg.bounds[:-1] + np.arange(seg.n)
    own = np.full(len(ids) + seg.n, end, np.int64)
    own[np.arange(len(ids)) + seg.rows()] = ids
    context = np.concatenate([[start], own[:-1]])
    context[first] = start
    return own, context, first


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ of the numbers of things counted once, twice, three and four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k - 0.5
        out.append(min(max(d, LEAST_DISCOUNT), float(k)))
    return out


def _discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _merge(blobs: DataFrame, parts: int, run, schema: str) -> DataFrame:
    """Each shard to a task of its own."""
    return blobs.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard").mapInArrow(run, schema)


def train(texts: DataFrame, at: str | None = None, shard_bytes: int = SHARD_BYTES) -> dict:
    """A model of the column ``text`` of ``texts``: figures and the place of its files."""
    import pyarrow as pa

    spark = texts.sparkSession
    at = at or shared.folder(spark, "lm")
    texts = texts.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (-(-size // shard_bytes) - 1).bit_length())
    parts, top, hashed = 1 << bits, _top(bits), _hashed(bits)

    def words(salt):
        def run(batches):
            t = Words(top)
            for b in batches:
                for seg in segments(b.column(0), NOT_SPACE):
                    ends = np.full(seg.n, END, np.uint64)
                    if t.add(np.append(seg.hashes(salt), ends), np.append(seg.hashes(salt + CHECK), ends)):
                        yield from _blob_batches(t.blobs())
            yield from _blob_batches(t.blobs())

        return run

    def sums(salt):
        def run(batches):
            for s, rows in _by_shard(batches):
                both = [(unplanes(r[1][: len(r[1]) // 2], np.uint64), unplanes(r[1][len(r[1]) // 2 :], np.uint64)) for r in rows]
                k, _, c = told_apart(np.concatenate([unpack(r[0]) for r in rows]), np.concatenate([x[1] for x in both]), np.concatenate([x[0] for x in both]))
                save(f"{at}/words-{salt}-{s}", k, c)
                yield _batch([(s, len(k), int(c.sum()), int((k[1:] == k[:-1]).sum()))], ("shard", "n", "total", "clashes"), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))

        return run

    salt = -1
    while True:  # another function where two words have one hash, which is chance, a few times in 2^64 for each pair
        salt += 1
        # a row a shard
        found = {r.shard: r for r in _merge(texts.mapInArrow(words(salt), BLOBS), parts, sums(salt), "shard int, n long, total long, clashes long").collect()}
        if not any(r.clashes for r in found.values()):
            break
    sizes = [found[s].n if s in found else 0 for s in range(1 << bits)]
    v, n = sum(sizes), sum(r.total for r in found.values())
    model = {"at": at, "bits": bits, "salt": salt, "words": sizes, "v": v, "n": n, "pairs": [0] * (1 << bits), "d": [0.0] * 3, "low": [0.0] * 3, "mass": 1.0, "types": 0}
    if not n:
        return model
    if v + 1 >= 1 << 32:
        raise ValueError(f"{v} words are too many for pairs of 32-bit ids")
    vocabulary = Shards(f"{at}/words-{salt}", sizes, top)

    def pairs(batches):
        t = Tally(hashed)
        end = int(vocabulary.find(np.array([END]))[0][0])
        for b in batches:
            for seg in segments(b.column(0), NOT_SPACE, SCORED_BYTES):
                u, back = np.unique(seg.hashes(salt), return_inverse=True)
                own, context, _ = _tokens(seg, vocabulary.find(u)[0][back], end, v)
                if t.add((context.astype(np.uint64) << np.uint64(32)) | own.astype(np.uint64)):
                    yield from _blob_batches(t.blobs())
        yield from _blob_batches(t.blobs())

    def pair_sums(batches):
        """Files of pairs; their counts of counts; what ids get from them, by range of ids."""
        low = np.uint64(0xFFFFFFFF)
        for s, rows in _by_shard(batches):
            k, c = added(np.concatenate([unpack(r[0]) for r in rows]), np.concatenate([unplanes(r[1], np.uint64) for r in rows]))
            save(f"{at}/pairs-{s}", k, c)
            seen = np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)[1:5].tolist()
            yield _batch([(-1 - s, len(k), seen, b"", b"", b"")], ("shard", "n", "seen", "ids", "values", "kind"), _PAIR_TYPES())
            context, first = np.unique(k >> np.uint64(32), return_index=True)
            values = [np.add.reduceat(x.astype(np.uint64), first) for x in (c, c == 1, c == 2, c >= 3)]
            yield from _ranges(context, values, b"c")
            word, times = np.unique(k & low, return_counts=True)
            yield from _ranges(word, [times.astype(np.uint64)], b"w")

    def _PAIR_TYPES():
        return pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()

    def _ranges(ids, values, kind):
        rows = []
        for a, b in runs(ids // np.uint64(RANGE)):
            r = int(ids[a]) // RANGE
            rows.append((r, 0, None, pack(ids[a:b] - np.uint64(r * RANGE)), b"".join(planes(x[a:b]) for x in values), kind))
        if rows:
            yield _batch(rows, ("shard", "n", "seen", "ids", "values", "kind"), _PAIR_TYPES())

    schema = "shard int, n long, seen array<long>, ids binary, values binary, kind binary"
    both = shared.written(_merge(texts.mapInArrow(pairs, BLOBS), parts, pair_sums, schema), "pairs")
    heads = both.filter("shard < 0").select("shard", "n", "seen").collect()  # a row a shard
    for r in heads:
        model["pairs"][-1 - r.shard] = r.n
    model["d"] = discounts([sum(r.seen[i] for r in heads) for i in range(4)])

    def figures(batches):
        for r, rows in _by_shard(batches):
            out = np.zeros((5, RANGE), np.uint64)
            for ids, values, kind in rows:
                i, raw = unpack(ids).astype(np.int64), values
                for j in range(4) if kind == b"c" else (4,):
                    out[j][i] += unplanes(raw[: 8 * len(i)], np.uint64)
                    raw = raw[8 * len(i) :]
            save(f"{at}/figures-{r}", out)
            seen = np.bincount(np.minimum(out[4], 5).astype(np.int64), minlength=6)[1:].tolist()
            yield _batch([(r, seen, int(out[4].sum()))], ("range", "seen", "total"), (pa.int32(), pa.list_(pa.int64()), pa.int64()))

    own = _merge(both.filter("shard >= 0").select("shard", "ids", "values", "kind"), v // RANGE + 1, figures, "range int, seen array<long>, total long").collect()  # a row a range
    seen = [sum(r.seen[i] for r in own) for i in range(5)]
    model["types"] = sum(r.total for r in own)
    model["low"] = discounts(seen)
    model["mass"] = sum(d * m for d, m in zip(model["low"], (seen[0], seen[1], seen[2] + seen[3] + seen[4]), strict=True)) / model["types"]
    return model


# Scoring


class Scorer:
    def __init__(self, m: dict):
        self.m = m
        self.words = Shards(f"{m['at']}/words-{m['salt']}", m["words"], _top(m["bits"]))
        self.pairs = Shards(f"{m['at']}/pairs", m["pairs"], _hashed(m["bits"]))
        self.end = int(self.words.find(np.array([END]))[0][0]) if m["n"] else -1

    def figures(self, ids: np.ndarray) -> np.ndarray:
        """Five rows of figures of sorted ids."""
        out = np.zeros((5, len(ids)))
        for a, b in runs(ids // RANGE):
            r = int(ids[a]) // RANGE
            out[:, a:b] = mapped(f"{self.m['at']}/figures-{r}").view(np.uint64).reshape(5, RANGE)[:, ids[a:b] - r * RANGE]
        return out

    def rows(self, seg):
        """For each row: tokens, known tokens, base score, score."""
        m = self.m
        u, back = np.unique(np.append(seg.hashes(m["salt"]), END), return_inverse=True)
        place, count = self.words.find(u)
        own, context, first = _tokens(seg, place[back[:-1]], self.end, m["v"])
        times, _, _ = _tokens(seg, count[back[:-1]], int(count[back[-1]]), 0)
        base = np.log10((times + 1) / (m["n"] + m["v"] + 1))
        low = np.full(len(own), m["mass"] / (m["v"] + 1))
        p = low
        if m["n"]:
            ids, at = np.unique(np.concatenate([own, context]), return_inverse=True)
            at, known = at.reshape(-1), ids >= 0
            f = np.zeros((5, len(ids)))
            f[:, known] = self.figures(ids[known])
            follow = f[4].astype(np.int64)
            low = (np.maximum(follow - _discounted(follow, m["low"]), 0) / m["types"] + m["mass"] / (m["v"] + 1))[at[: len(own)]]
            total = f[0]
            left = np.where(total > 0, (m["d"][0] * f[1] + m["d"][1] * f[2] + m["d"][2] * f[3]) / np.maximum(total, 1), 1.0)
            keys = np.where((own >= 0) & (context >= 0), (np.maximum(context, 0).astype(np.uint64) << np.uint64(32)) | np.maximum(own, 0).astype(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
            q, back = np.unique(keys, return_inverse=True)
            c = self.pairs.find(q)[1][back]
            t = total[at[len(own) :]]
            p = np.maximum(c - _discounted(c, m["d"]), 0) / np.maximum(t, 1) + left[at[len(own) :]] * low
        sums = lambda x: np.add.reduceat(x, first) if len(first) else x
        return np.diff(seg.bounds) + 1, sums((times > 0).astype(np.int64)), sums(base), sums(np.log10(p))


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    def run(batches):
        import pyarrow as pa

        s = Scorer(model)
        for b in batches:
            for seg in segments(b.column(1), NOT_SPACE, SCORED_BYTES):
                yield pa.RecordBatch.from_arrays([b.column(0)[seg.first : seg.first + seg.n], *map(pa.array, s.rows(seg))], names=["id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(score: float, n_tokens: int) -> float:
    return math.pow(10, -score / n_tokens)


def op6_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs.filter(~held_out(F.col("doc_id")))))
