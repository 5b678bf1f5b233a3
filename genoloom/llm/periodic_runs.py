"""Periodic runs: stretches of words that repeat with a period, and texts without the repeats.

A run is a stretch of consecutive words with smallest period ``q``, at least ``max(minimum, 3 * q)`` words long, that no
neighbouring word extends keeping the period. Heavy/light lag counting finds the lags that can have one: for each lag it counts the equal
words that far apart, by pair differences for words that are rare in the text and by exact autocorrelation (a Fourier transform of the
places of each) for frequent ones. A run of lag ``q`` has ``length - q`` such pairs in a row, so that only lags with that many get an island scan.
Two rules spare scans, and neither loses a run:

* pairs inside a run of a period that divides the lag belong to no run of that lag as its smallest period (both would share ``q`` words or more,
  hence the lesser period), so they are not counted;
* an island of ``2 * q`` pairs or more covers all of a stretch from ``t * q`` to ``(t + 1) * q`` for some ``t``, so that a long
  lag is scanned only if such a stretch begins with ``PROBES`` equal pairs.

Words are compared as they are, by numbers that each text gives them. A text is taken in pieces of ``PIECE`` bytes; besides its bytes a worker
holds its words' numbers, its vocabulary and a few arrays of its length.

Defined results: null counts as empty; an empty text, or one of few words, has no runs; the collapsed text is the kept words joined by
one space; rows with a null id and repeated rows are rows like any other; an empty table gives an empty result; other columns are
not read by ``periodic_runs`` and kept by ``collapse_runs``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from genoloom.llm import shared
from genoloom.llm.wordarrays import NOT_SPACE, column

MINIMUM, TIMES = 24, 3
#: Bytes of a text whose words are held as objects at a time; pairs that a long lag's stretch begins with, and from which lag on.
PIECE, PROBES, LONG = 1 << 20, 16, 64
SPACES = " \\t\\n\\x0B\\f\\r"


def numbers(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words' numbers, and the distinct words in the order of their first places."""
    own: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        to = min(at + PIECE, len(text))
        while to < len(text) and NOT_SPACE[text[to]]:  # the rest of the last word
            to += 1
        words = text[at:to].split()
        parts.append(np.fromiter((own.setdefault(w, len(own)) for w in words), np.int32, len(words)))
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(own)


def lag_counts(w: np.ndarray, most: int) -> np.ndarray:
    """For each lag up to ``most``, the pairs of equal words that far apart."""
    out = np.zeros(most + 1, np.int64)
    size = np.bincount(w)
    heavy = int(np.sqrt(len(w)) / 2) + 4
    order = np.argsort(w, kind="stable")  # places, by word
    light = order[size[w[order]] <= heavy]
    word = w[light]
    for k in range(1, min(heavy, len(word))):
        same = np.flatnonzero(word[k:] == word[:-k])
        if not len(same):
            break
        lag = light[same + k] - light[same]
        out += np.bincount(lag[lag <= most], minlength=most + 1)
    often = np.flatnonzero(size > heavy)
    if len(often):
        width = 1 << int(len(w) + most).bit_length()
        power = np.zeros(width // 2 + 1)
        for c in often.tolist():
            power += np.abs(np.fft.rfft(w == c, width)) ** 2
        out += np.rint(np.fft.irfft(power, width)[: most + 1]).astype(np.int64)
    return out


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def find_runs(w: np.ndarray, minimum: int = MINIMUM, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in the order of start and period."""
    n = len(w)
    if n < max(minimum, times):
        return []
    most = n // times
    need = np.maximum(minimum - np.arange(most + 1), (times - 1) * np.arange(most + 1))
    count = lag_counts(w, most)
    count[0] = -1
    found = []
    for q in np.flatnonzero(count >= need).tolist():
        if count[q] < need[q]:  # less the pairs of runs found meanwhile
            continue
        if q >= LONG:
            first = np.arange(0, n - q, q)
            first = first[first + PROBES + q <= n]
            on = np.ones(len(first), bool)
            for j in range(PROBES):
                on &= w[first + j] == w[first + j + q]
            if not on.any():
                continue
        same = np.zeros(n - q + 2, bool)
        same[1:-1] = w[q:] == w[:-q]
        start, end = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
        for s, e in zip(*(x[end - start >= need[q]].tolist() for x in (start, end)), strict=True):
            if any(np.array_equal(w[s : e + q - q // p], w[s + q // p : e + q]) for p in _primes(q)):
                continue  # a lesser period
            found.append((s, e - s + q, q))
            lags = np.arange(q, min(most, e - s + q) + 1, q)
            count[lags] -= e - s + q - lags
    return sorted(found, key=lambda x: (x[0], x[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that no run holds after its first period."""
    step = np.zeros(n + 1, np.int32)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    return np.cumsum(step[:-1]) == 0


def _collapsed(text: bytes, w: np.ndarray, words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if len(text) <= PIECE:
        own = text.split()
        return b" ".join(own if not runs else [own[i] for i in np.flatnonzero(_kept(len(w), runs)).tolist()])
    kept = w[_kept(len(w), runs)]
    return b" ".join(b" ".join([words[i] for i in kept[k : k + PIECE].tolist()]) for k in range(0, len(kept), PIECE))


def _scan(minimum: int, times: int):
    @shared.trims
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, o = column(b.column(1))
            data, held, at = memoryview(data), 0, 0
            places, runs, n_words, out = [0], [], [], []
            for k in range(b.num_rows):
                text = bytes(data[o[k] : o[k + 1]])
                w, words = numbers(text)
                own = find_runs(w, minimum, times)
                runs += own
                places.append(len(runs))
                n_words.append(len(w))
                out.append(_collapsed(text, w, words, own))
                held += len(text)
                if held >= 8 * PIECE or k + 1 == b.num_rows:
                    cols = np.array(runs, np.int64).reshape(-1, 3)
                    each = pa.StructArray.from_arrays([pa.array(cols[:, i]) for i in range(3)], names=["start", "length", "period"])
                    rids = b.column(0)[at : k + 1]
                    yield pa.RecordBatch.from_arrays([rids, pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(places, pa.int32()), each), pa.array(out, pa.binary()).cast(pa.string())], names=["_key", "n_words", "runs", "collapsed"])
                    held, at = 0, k + 1
                    places, runs, n_words, out = [0], [], [], []

    return run


_RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", minimum: int = MINIMUM, times: int = TIMES) -> DataFrame:
    """One row a document: the id, n_words, runs (start, length and period of each, in the order of start and period) and the collapsed text."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).mapInArrow(_scan(minimum, times), f"_key {kind}, {_RESULT}").withColumnRenamed("_key", id_col)


def collapse_runs(docs: DataFrame, text_col: str = "text", minimum: int = MINIMUM, times: int = TIMES) -> DataFrame:
    """``docs`` with the repeats of runs taken from the texts; texts without runs stay as they are."""
    docs = shared.numbered(docs)
    own = docs.select(F.col(shared.RID).alias("_key"), F.col(text_col).alias("_text")).mapInArrow(_scan(minimum, times), f"_key long, {_RESULT}").filter(F.size("runs") > 0)
    own = own.select(F.col("_key").alias(shared.RID), F.col("collapsed").alias("_collapsed_of_genoloom"))
    return docs.join(own, shared.RID, "left").withColumn(text_col, F.coalesce("_collapsed_of_genoloom", text_col)).drop(shared.RID, "_collapsed_of_genoloom").select(*[c for c in docs.columns if c != shared.RID])


def longest(runs: Column) -> Column:
    """The run with the greatest length by period; of equals that with the least start, then the least period. Null for none."""
    before = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | ((x["length"] * y["period"] == y["length"] * x["period"]) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
    return F.get(F.array_sort(runs, lambda x, y: F.when(before(x, y), -1).when(before(y, x), 1).otherwise(0)), 0)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which one text of ten ends in a repeat of its own words, by the CRC of its id."""
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.filter(F.split(text_col, f"[{SPACES}]+"), lambda x: x != "")
    n, g = F.size("_words").cast("long"), F.floor(h / 10).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p")))
    marked = docs.withColumn("_words", F.when(h % 10 == 0, words))
    marked = marked.withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p))
    new = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("_words", place(i).cast("int"))), " ")
    return marked.withColumn(text_col, F.when(F.col("_a").isNotNull(), new).otherwise(F.col(text_col))).drop("_words", "_a", "_p")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic_runs(repeated(docs)).withColumn("_top", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_top.start").alias("start"),
        F.col("_top.length").alias("length"),
        F.col("_top.period").alias("period"),
        F.expr("_top.length * 1000 DIV _top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
