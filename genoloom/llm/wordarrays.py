"""Words of Arrow string columns as numpy arrays: byte spans, rows and 64-bit hashes, no Python object a word.

Texts are taken in segments of about ``SEGMENT`` bytes, so that memory stays bounded for any batch; one
longer text is a segment of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
#: Bytes of the longest word that is hashed with all others at once.
LONG = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: all but ASCII white space; digits, letters and all beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


class Segment:
    """Rows ``first`` to ``first + n`` of a column: lower-cased bytes, offsets, and the spans of words."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.first, self.n, self.offsets = first, len(offsets) - 1, offsets
        self.data = LOWER[data]
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = table[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
        self.ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
        #: Words before each row; the last is the number of all.
        self.bounds = np.searchsorted(self.starts, offsets)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.bounds))

    def hashes(self, salt: int = 0) -> np.ndarray:
        return hashed(self.data, self.starts, self.ends, salt)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of spans of ``data``, mixed after each eight bytes; spans of more than ``LONG`` bytes by XXH3. Another ``salt``
    is another function."""
    length = ends - starts
    out = mixed(length.astype(np.uint64) + np.uint64(salt * int(_ODD) % (1 << 64)))
    buffer = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, "<u8", buffer, strides=(1,))
    at, j = np.flatnonzero(length <= LONG), 0
    while len(at):
        left = np.minimum(length[at] - j, 8)
        out[at] = mixed(out[at] ^ (wide[starts[at] + j] & _MASKS[left]))
        j += 8
        at = at[length[at] > j]
    at = np.flatnonzero(length > LONG)
    if len(at):
        from xxhash import xxh3_64_intdigest

        out[at] = [xxh3_64_intdigest(buffer[a:b], salt) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiply-xorshift hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def column(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    arr = (arr.fill_null("") if arr.null_count else arr).cast(pa.large_string())
    _, offsets, data = arr.buffers()
    o = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), o


def segments(arr, table: np.ndarray, most: int = SEGMENT) -> Iterator[Segment]:
    data, o = column(arr)
    k, n = 0, len(o) - 1
    while k < n:
        to = max(k + 1, int(np.searchsorted(o, o[k] + most, "right")) - 1)
        yield Segment(k, data[o[k] : o[to]], o[k : to + 1] - o[k], table)
        k = to
