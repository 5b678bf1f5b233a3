"""Alignments near given diagonals, and cheap bounds before them: many pairs at once, a row at a time, in numpy.

Memory follows the band, not the product of lengths. ``alignment.aligned`` is the same without a band, and the tests' yardstick.
"""

from __future__ import annotations

import numpy as np

from genoloom.functions.alignment import EXTEND, OPEN, SCORES

_LOW = -(10**6)
#: Cells of the bands of pairs that are aligned at once.
CELLS = 1 << 23
#: Of bounds of scores: what is between texts, places of texts and pairs that are looked at together, and the bound that says nothing.
WIDE, SPACED, PAIRS, BEYOND = 128, 1 << 19, 1 << 12, 1 << 40


def batches(pairs: list[tuple[bytes, bytes]], bands: list[tuple[int, int]]) -> list[list[int]]:
    """Places of the pairs, alike in length and width of band, in lists whose bands have ``CELLS`` cells at most together."""
    order = sorted(range(len(pairs)), key=lambda k: (bands[k][1] - bands[k][0], len(pairs[k][0])))
    out: list[list[int]] = []
    most = wide = 0
    for k in order:
        rows, width = len(pairs[k][0]) + 1, bands[k][1] - bands[k][0] + 1
        most, wide = max(most, rows), max(wide, width)
        if not out or (len(out[-1]) + 1) * most * wide > CELLS:
            out.append([])
            most, wide = rows, width
        out[-1].append(k)
    return out


def _laid(seqs: list[bytes]) -> np.ndarray:
    out = np.zeros((len(seqs), max(map(len, seqs)) + 2), np.uint8)
    for k, s in enumerate(seqs):
        out[k, 1 : len(s) + 1] = np.frombuffer(s, np.uint8)
    return out


def aligned(pairs: list[tuple[bytes, bytes]], bands: list[tuple[int, int]], paths: bool = True, scores: np.ndarray = SCORES, open_: int = OPEN, extend: int = EXTEND) -> list[tuple[int, list[tuple[int, int]]]]:
    """(score, path) of the best local alignment of each pair whose places (i, j) keep ``lo <= j - i <= hi``; without ``paths`` scores only.

    A gap along the first sequence is a running maximum over the row, as one that is opened where another has just
    ended never pays.
    """
    out: list = [None] * len(pairs)
    for own in batches(pairs, bands):
        for k, x in zip(own, _band([pairs[k] for k in own], [bands[k] for k in own], paths, scores, open_, extend), strict=True):
            out[k] = x
    return out


def identities(pairs: list[tuple[bytes, bytes]], bands: list[tuple[int, int]], scores: np.ndarray = SCORES, open_: int = OPEN, extend: int = EXTEND) -> np.ndarray:
    """Identical residues of the paths that ``aligned`` gives, counted without the paths."""
    out = np.zeros(len(pairs), np.int64)
    for own in batches(pairs, bands):
        out[own] = _band([pairs[k] for k in own], [bands[k] for k in own], True, scores, open_, extend, _identical)
    return out


def identities_without_gaps(pairs: list[tuple[bytes, bytes]], reach: int, scores: np.ndarray = SCORES, open_: int = OPEN, extend: int = EXTEND) -> np.ndarray:
    """``identities`` of pairs of equal length in bands of ``reach`` at most on either side where no gap can pay; -1 where one may.

    Two gaps cost more than the main diagonal loses to what the first text's residues score at best; and with one gap, or none on another diagonal, no stretch
    before any place and one after it score as much as the best of the main diagonal alone. That is then the only best alignment."""
    out, cost, wide = np.full(len(pairs), -1, np.int64), open_ + extend, 2 * reach + 1
    lengths = np.array([len(a) for a, _ in pairs], np.int64)
    order = np.argsort(lengths, kind="stable")
    top = np.maximum(scores.max(axis=1), 0).astype(np.int64)
    for k in range(0, len(order), 1024):
        own = order[k : k + 1024]
        own = own[lengths[own] > 0]
        if not len(own):
            continue
        n = int(lengths[own].max())
        x, y = np.zeros((len(own), n), np.uint8), np.zeros((len(own), n + 2 * reach), np.uint8)
        for p, i in enumerate(own.tolist()):
            a, b = pairs[i]
            x[p, : len(a)], y[p, reach : reach + len(b)] = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
        letters = np.unique(np.concatenate([[0], np.unique(x), np.unique(y)]))
        code = np.zeros(256, np.int64)
        code[letters] = np.arange(len(letters))
        table = scores[letters][:, letters].astype(np.int16)
        table[0], table[:, 0] = -1000, -1000  # nothing goes on beyond an end
        first, second = code[x] * len(letters), code[y]
        s = np.empty((n, wide, len(own)), np.int16)  # the main diagonal first
        for at, d in enumerate([reach, *(d for d in range(wide) if d != reach)]):
            np.take(table.ravel(), first + second[d : d + n], out=s[:, at], mode="clip")
        equal = (x == y[reach : reach + n]) & (x > 0)
        best = np.zeros((n + 1, 2, len(own)), np.int16)  # up to a row, of the main diagonal and of others
        h, same, most = np.zeros((wide, len(own)), np.int16), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for r in range(n):
            h += s[r]
            np.maximum(h, 0, out=h)
            same = np.where(h[0] > 0, same + equal[r], 0)
            most = np.where(h[0] > best[r, 0], same, most)
            np.maximum(best[r, 0], h[0], out=best[r + 1, 0])
            np.maximum(best[r, 1], h[1:].max(axis=0), out=best[r + 1, 1])
        h, after, worst = np.zeros((wide, len(own)), np.int16), np.zeros((2, len(own)), np.int16), np.zeros(len(own), np.int16)
        for r in range(n - 1, -1, -1):  # what comes after row r and what is up to it
            both = np.maximum(best[r + 1, 0] + after[1], best[r + 1, 1] + np.maximum(after[0], after[1]))
            np.maximum(worst, both, out=worst)
            h += s[r]
            np.maximum(h, 0, out=h)
            np.maximum(after[0], h[0], out=after[0])
            np.maximum(after[1], h[1:].max(axis=0), out=after[1])
        main = best[n, 0].astype(np.int64)
        sure = (worst - cost < main) & (best[n, 1] < main) & (top[x].sum(axis=0) - 2 * cost < main)
        out[own[sure]] = most[sure]
    return out


def _identical(moves, at, lo, q, t):
    """Of many pairs at once: back along the path, as in ``_band``, a step of all at a time."""
    who, (i, j) = np.arange(len(lo)), at.T
    state, same = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
    while len(who):
        mv = moves[i, who, j - i - lo[who]]
        step = np.where(state == 0, mv & 3, state)
        both = step == 1
        same[who[both]] += q[who[both], i[both]] == t[who[both], j[both]]
        state = np.where(((step == 2) & (mv & 4 > 0)) | ((step == 3) & (mv & 8 > 0)), step, 0)
        i, j = i - (both | (step == 3)), j - (both | (step == 2))
        on = (step > 0) & (i > 0) & (j > 0)
        who, i, j, state = who[on], i[on], j[on], state[on]
    return same


def _band(pairs, bands, paths, scores, open_, extend, followed=None):
    n_pairs, lo = len(pairs), np.array([b[0] for b in bands])
    la, lb = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    width = max(hi - l + 1 for l, hi in bands)
    q, t = _laid([a for a, _ in pairs]), _laid([b for _, b in pairs])
    h, f = np.zeros((n_pairs, width + 1), np.int32), np.full((n_pairs, width + 1), _LOW, np.int32)  # one cell beyond the band
    h[:, -1] = _LOW
    best, at = np.zeros(n_pairs, np.int64), np.zeros((n_pairs, 2), np.int64)
    slope = np.arange(width, dtype=np.int32) * extend
    cells = np.arange(width)
    moves = np.zeros((int(la.max()) + 1, n_pairs, width), np.uint8) if paths else None  # 1 both, 2 of t alone, 3 of q alone; 4 and 8: these go on
    who = np.arange(n_pairs)
    for i in range(1, int(la.max()) + 1):
        j = i + lo[:, None] + cells
        inside = (j >= 1) & (j <= lb[:, None]) & (i <= la)[:, None]
        diag = h[:, :-1] + scores[q[:, i][:, None], t[who[:, None], np.clip(j, 0, t.shape[1] - 1)]]
        fo, fe = h[:, 1:] - open_ - extend, f[:, 1:] - extend
        down = np.maximum(fo, fe)
        top = np.where(inside, np.maximum(np.maximum(diag, down), 0), 0)
        run = np.maximum.accumulate(top + slope, axis=1)
        right = np.full_like(top, _LOW)
        right[:, 1:] = run[:, :-1] - open_ - slope[1:]
        now = np.where(inside, np.maximum(top, right), 0)
        if paths:
            mv = np.where(now <= 0, 0, np.where(now == diag, 1, np.where(now == right, 2, 3))).astype(np.uint8)
            goes = np.zeros((n_pairs, width), bool)
            goes[:, 1:] = right[:, 1:] > now[:, :-1] - open_ - extend
            mv |= goes.astype(np.uint8) << 2 | (fe > fo).astype(np.uint8) << 3
            moves[i] = mv
        k = now.argmax(axis=1)
        high = now[who, k]
        new = (high > best) | ((high == best) & (high > 0) & (2 * i + lo + k < at.sum(axis=1)))
        best[new] = high[new]
        at[new, 0], at[new, 1] = i, (i + lo + k)[new]
        h[:, :-1], f[:, :-1] = now, np.where(inside, down, _LOW)
    if not paths:
        return [(int(s), []) for s in best]
    if followed:
        return followed(moves, at, lo, q, t)
    out = []
    for p in range(n_pairs):
        (i, j), path, state, shift = at[p].tolist(), [], 0, int(lo[p])
        while i > 0 and j > 0:
            mv = int(moves[i, p, j - i - shift])
            if state == 0:
                step = mv & 3
                if step == 0:
                    break
                if step == 1:
                    path.append((i - 1, j - 1))
                    i, j = i - 1, j - 1
                    continue
                state = step
            if state == 2:
                path.append((-1, j - 1))
                state = 2 if mv & 4 else 0
                j -= 1
            else:
                path.append((i - 1, -1))
                state = 3 if mv & 8 else 0
                i -= 1
        out.append((int(best[p]), path[::-1]))
    return out


def ungapped(a: np.ndarray, b: np.ndarray, diagonal: int, scores: np.ndarray = SCORES) -> int:
    """The best score of a stretch without gaps on the diagonal ``j - i``."""
    i, j = max(0, -diagonal), max(0, diagonal)
    n = min(len(a) - i, len(b) - j)
    if n <= 0:
        return 0
    total = np.cumsum(scores[a[i : i + n], b[j : j + n]])
    return int(max((total - np.minimum(np.minimum.accumulate(np.concatenate([[0], total[:-1]])), 0)).max(), 0))


def stretches(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, scores: np.ndarray = SCORES) -> np.ndarray:
    """``ungapped`` of many: the best score of a stretch without gaps of the ``n`` residues from ``i`` on of ``a`` beside those from ``j`` on of ``b``."""
    out, flat, width = np.zeros(len(n), np.int32), np.ascontiguousarray(scores, np.int32).ravel(), scores.shape[1]
    order = np.argsort(-n, kind="stable")
    for k in range(0, len(order), 1 << 14):
        own = order[k : k + (1 << 14)]
        most, x, y = -n[own], i[own], j[own]
        now, best = np.zeros(len(own), np.int32), np.zeros(len(own), np.int32)
        for t in range(int(-most[0])):
            go = int(np.searchsorted(most, -t))  # longer ones come first
            now[:go] += flat[a[x[:go] + t].astype(np.int64) * width + b[y[:go] + t]]
            np.maximum(now[:go], 0, out=now[:go])
            np.maximum(best[:go], now[:go], out=best[:go])
        out[own] = best
    return out


def score_bounds(texts: list[bytes], others: list[bytes], a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, scores: np.ndarray = SCORES, open_: int = OPEN, extend: int = EXTEND) -> np.ndarray:
    """What no alignment of ``texts[a]`` and ``others[b]`` in the band ``lo <= j - i <= hi`` scores above; ``BEYOND`` where that isn't known.

    An alignment is stretches without gaps, one after the other along the first text, and a gap, of ``open_ + extend`` at least, between each and the
    next. So no score is lost where a stretch may go on from the best that any diagonal of the band has had before, less that cost. Many pairs take
    a step along all their diagonals at once, in bytes; a pair whose sums come near what a byte holds isn't known."""
    out, cost = np.full(len(a), BEYOND, np.int64), open_ + extend
    la, lb = np.array([len(x) for x in texts], np.int64), np.array([len(x) for x in others], np.int64)
    known = np.flatnonzero((hi - lo < WIDE - 8) & (hi >= -la[a]) & (lo <= lb[b]))
    most = 127 - int(scores.max())  # a byte holds one step more
    if not len(known) or cost > 25 or np.abs(scores).max() > 25:
        return out
    known = known[np.argsort(b[known], kind="stable")]
    room = np.cumsum(lb + WIDE)
    letters = np.unique(np.frombuffer(b"".join([b"\0", *texts, *others]), np.uint8))
    code = np.zeros(256, np.int64)
    code[letters] = np.arange(len(letters))
    table = scores[letters][:, letters].astype(np.int8)
    table[0], table[:, 0] = -100, -100  # nothing goes on beyond an end
    x, start = code[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)], np.cumsum(la + 1) - la - 1
    k = 0
    while k < len(known):  # some of the others at a time
        first = b[known[k]]
        last = max(first + 1, int(np.searchsorted(room, (room[first - 1] if first else 0) + SPACED, "right")))
        to = int(np.searchsorted(b[known], last))
        y = np.frombuffer((b"\0" * WIDE).join([b"", *others[first:last], b""]), np.uint8)
        at = WIDE + np.cumsum(lb[first:last] + WIDE) - lb[first:last] - WIDE
        profile = np.ascontiguousarray(table[:, code[y]])
        own, k = known[k:to], to
        rows = np.minimum(la[a[own]], lb[b[own]] - lo[own]) - np.maximum(0, -hi[own])
        own = own[np.lexsort((-rows, hi[own] - lo[own]))]
        for m in range(0, len(own), PAIRS):
            some = own[m : m + PAIRS]
            wide, i = int((hi[some] - lo[some]).max()) // 8 * 8 + 8, np.maximum(0, -hi[some])
            rows = np.minimum(la[a[some]], lb[b[some]] - lo[some]) - i
            some, i, rows = (z[np.argsort(-rows, kind="stable")] for z in (some, i, rows))
            windows = np.ndarray((profile.size - wide + 1,), f"V{wide}", profile, strides=(1,))
            here, there = start[a[some]] + i, at[b[some] - first] + i + lo[some]
            # best so far of all of a pair's diagonals, the cost at least, in each of them; free is that less the cost
            now, free, best = (np.full((len(some), wide), z, np.int8) for z in (0, 0, cost))
            for r in range(int(rows[0])):
                n = int(np.searchsorted(-rows, -r))  # longer ones come first
                step = windows[x[here[:n] + r] * len(y) + (there[:n] + r)].view(np.int8).reshape(n, wide)
                np.maximum(now[:n], free[:n], out=now[:n])
                np.add(now[:n], step, out=now[:n])
                if len(new := np.flatnonzero((now[:n] > best[:n]).view(np.uint64) != 0)):  # eight diagonals at a time
                    new = new // (wide // 8)
                    new = new[np.append(True, new[1:] != new[:-1])]
                    high = now[new].max(axis=1)
                    best[new], free[new] = high[:, None], (high - cost)[:, None]
            out[some] = np.where(best[:, 0] < most, best[:, 0].astype(np.int64), BEYOND)
    return out


def edit_distances(pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Edit distances by bit vectors: a bit of a word for each place of the first sequence, a step for each of the second, and the words of all
    pairs at once; a carry goes from word to word."""
    if not pairs:
        return np.zeros(0, np.int64)
    la, lb = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    n, words, who = len(pairs), max(1, -(-int(la.max()) // 64)), np.arange(len(pairs))
    q, t = _laid([a for a, _ in pairs])[:, 1:], _laid([b for _, b in pairs])[:, 1:]
    has = np.zeros((256, n, words), np.uint64)  # of each letter, its places
    for i in range(int(la.max())):
        on = np.flatnonzero(la > i)
        has[q[on, i], on, i // 64] |= np.uint64(1) << np.uint64(i % 64)
    one, up = np.uint64(1), np.full((n, words), np.uint64(0xFFFFFFFFFFFFFFFF))
    down = np.zeros((n, words), np.uint64)
    last, bit = np.maximum(la - 1, 0) // 64, np.left_shift(one, (np.maximum(la - 1, 0) % 64).astype(np.uint64))
    distance = la.astype(np.int64).copy()
    for j in range(int(lb.max())):
        go = lb > j
        more, less = np.ones(n, np.uint64), np.zeros(n, np.uint64)  # what comes in from the row above: the first row grows by one a step
        for w in range(words):
            eq, p, m = has[t[:, j], who, w], up[:, w], down[:, w]
            v = eq | m
            eq = eq | less
            x = (((eq & p) + p) ^ p) | eq
            plus, minus = m | ~(x | p), p & x
            here = go & (last == w)
            distance += (here & ((plus & bit) != 0)).astype(np.int64) - (here & ((minus & bit) != 0)).astype(np.int64)
            out_more, out_less = plus >> np.uint64(63), minus >> np.uint64(63)
            plus, minus = (plus << one) | more, (minus << one) | less
            up[:, w] = np.where(go, minus | ~(v | plus), p)
            down[:, w] = np.where(go, plus & v, m)
            more, less = out_more, out_less
    return np.where(la == 0, lb, distance)


def low_complexity(seq: bytes, window: int = 12, bits: float = 2.2) -> np.ndarray:
    """Residues of windows whose residues have an entropy of less than ``bits``."""
    return low_complexities([seq], window, bits)[0]


def low_complexities(seqs: list[bytes], window: int = 12, bits: float = 2.2) -> list[np.ndarray]:
    """``low_complexity`` of each, as one text whose windows across two sequences don't count."""
    length = np.array([len(s) for s in seqs], np.int64)
    x, ends = np.frombuffer(b"".join(seqs), np.uint8), np.cumsum(length)
    n = len(x)
    out = np.zeros(n, bool)
    if n >= window:
        of = np.sort(np.lib.stride_tricks.sliding_window_view(x, window), axis=1)
        entropy = np.zeros(len(of))
        run = np.ones(len(of))
        for k in range(1, window + 1):  # lengths of the runs of equal residues
            same = of[:, k] == of[:, k - 1] if k < window else np.zeros(len(of), bool)
            entropy -= np.where(same, 0.0, run / window * np.log2(run / window))
            run = np.where(same, run + 1, 1)
        inside = np.arange(len(of)) + window <= np.repeat(ends, length)[: len(of)]
        low = np.concatenate([[0], np.cumsum((entropy < bits) & inside)])
        first = np.maximum(np.arange(n) - window + 1, 0)
        out = low[np.minimum(np.arange(n) + 1, len(of))] > low[np.minimum(first, len(of))]
    return np.split(out, ends[:-1])
