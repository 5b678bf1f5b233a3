"""Profiles of aligned sequences, and their alignment to each other: a column is how often it has each letter."""

from __future__ import annotations

import itertools

import numpy as np

from genoloom.functions import alignment as al

#: Letters A to Z, and one for all else. Cells of a traceback; longer profiles keep to a band about the diagonal from corner to corner.
LETTERS, CELLS = 27, 1 << 27
#: Cells of the tracebacks of profiles that are aligned at once.
TOGETHER = 1 << 21
_LOW = -1e9
#: What share of opening a gap a letter pays that comes to stand beside a gap in another sequence, as few such gaps are long.
BESIDE = 0.35


def kind(protein: bool) -> tuple[np.ndarray, float, float, int]:
    """Scores of letters, the costs of gaps, and the length of words by which sequences are told to be near."""
    scores = al.SCORES if protein else al.identity_matrix()
    at = np.array([*range(65, 91), 42])
    return scores[np.ix_(at, at)].astype(np.float32), *((al.OPEN, al.EXTEND, 3) if protein else (4, 1, 7))


def profile(seq: str) -> np.ndarray:
    """Counts of the letters (columns) at the places (rows) of one sequence."""
    x = np.frombuffer(seq.upper().encode("ascii", "replace"), np.uint8).astype(np.int64) - 65
    out = np.zeros((len(x), LETTERS), np.float32)
    out[np.arange(len(x)), np.where((x >= 0) & (x < 26), x, 26)] = 1
    return out


def words(p: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct words of the most frequent letters of the columns that most sequences have."""
    most = p.sum(axis=1)
    own = p[most * 2 >= (most.max() if len(most) else 0)].argmax(axis=1).astype(np.int64)
    n = max(len(own) - k + 1, min(1, len(own)))
    out = np.zeros(n, np.int64)
    for j in range(min(k, len(own))):
        out = out * LETTERS + own[j : j + n]
    return np.unique(out)


def sketch(own: np.ndarray) -> list[int]:
    """Two MinHashes of the words: near sequences tend to stand near in their order."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = own.astype(np.uint64) * np.uint64(salt | 1)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(int((h ^ (h >> np.uint64(32))).min() >> np.uint64(1)) if len(h) else 0)
    return out


def tree(own: list[np.ndarray]) -> list[tuple[int, int]]:
    """The merges of average linkage by the share of words that are not shared, the nearest first; a merged pair is known by its first."""
    n = len(own)
    every, at = np.unique(np.concatenate(own), return_inverse=True)
    has = np.zeros((n, len(every)), np.float32)
    has[np.repeat(np.arange(n), [len(x) for x in own]), at] = 1
    size = np.maximum(has.sum(axis=1), 1)
    far = (1 - has @ has.T / np.minimum(size[:, None], size[None, :])).astype(np.float64)
    np.fill_diagonal(far, np.inf)
    weight, out = np.ones(n), []
    for _ in range(n - 1):
        i, j = sorted(np.unravel_index(far.argmin(), far.shape))
        out.append((int(i), int(j)))
        both = (far[i] * weight[i] + far[j] * weight[j]) / (weight[i] + weight[j])
        both[[i, j]] = np.inf
        far[i], far[:, i] = both, both
        far[j], far[:, j] = np.inf, np.inf
        weight[i] += weight[j]
    return out


def merged(a: np.ndarray, b: np.ndarray, scores: np.ndarray, open_: float, extend: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(profile, places of a's columns in it, places of b's): the best global alignment of two profiles, by mean scores of their letters.

    A gap opposite a column costs what share of the sequences has a letter there, and so do the gaps that two aligned columns bring together.
    """
    m, n = len(a), len(b)
    if not m or not n:
        return (a if m else b), np.arange(m), np.arange(n)
    fa, fb = a / max(a.sum(axis=1).max(), 1), b / max(b.sum(axis=1).max(), 1)
    full_a, full_b = fa.sum(axis=1), fb.sum(axis=1)
    fb = fb @ scores.T
    start, goes_on = open_ * np.concatenate([[0], full_b]).astype(np.float32), np.concatenate([[0], np.cumsum(extend * full_b)]).astype(np.float32)
    reach = max(int(CELLS // (m + 1)), abs(m - n) + 64) if (m + 1) * (n + 1) > CELLS else n
    moves = np.zeros((m + 1, n + 1), np.uint8) if reach >= n else None
    banded = {} if moves is None else None
    j = np.arange(n + 1, dtype=np.float32)
    h = -start[min(1, n)] - goes_on
    h[0] = 0
    f = np.full(n + 1, _LOW, np.float32)
    first = np.where(j > 0, 2 | np.where(j > 1, 4, 0), 0).astype(np.uint8)
    if moves is not None:
        moves[0] = first
    for i in range(1, m + 1):
        own = float(full_a[i - 1])
        fo, fe = h - (open_ + extend) * own, f - extend * own
        f = np.maximum(fo, fe)
        diag = np.full(n + 1, _LOW, np.float32)
        diag[1:] = h[:-1] + fb @ fa[i - 1] - (extend + BESIDE * open_) * (own + full_b - 2 * own * full_b)
        top = np.maximum(diag, f)
        lo, hi = 0, n + 1
        if banded is not None:  # columns about the diagonal
            middle = i * n // m
            lo, hi = max(0, middle - reach // 2), min(n + 1, middle + reach // 2 + 1)
            top[:lo], top[hi:] = _LOW, _LOW
        e = np.full(n + 1, _LOW, np.float32)
        e[1:] = np.maximum.accumulate(top[:-1] - start[1:] + goes_on[:-1]) - goes_on[1:]
        now = np.maximum(top, e)
        mv = np.where(now == diag, 1, np.where(now == e, 2, 3)).astype(np.uint8)
        goes = np.zeros(n + 1, bool)
        goes[1:] = e[1:] > now[:-1] - start[1:] + goes_on[:-1] - goes_on[1:] + 1e-3
        mv |= goes.astype(np.uint8) << 2 | (fe > fo).astype(np.uint8) << 3
        if banded is None:
            moves[i] = mv
        else:
            now[:lo], now[hi:] = _LOW, _LOW
            banded[i] = (lo, mv[lo:hi].copy())
        h = now
    at = lambda i, j: int(first[j]) if i == 0 else int(moves[i, j]) if moves is not None else int(banded[i][1][j - banded[i][0]])
    i, j, state, steps = m, n, 0, []
    while i or j:
        mv = at(i, j) if i else int(first[j])
        step = state or ((mv & 3) if i and j else 2 if j else 3)
        steps.append(step)
        if step == 1:
            i, j, state = i - 1, j - 1, 0
        elif step == 2:
            state = 2 if mv & 4 and j > 1 else 0
            j -= 1
        else:
            state = 3 if mv & 8 and i > 1 else 0
            i -= 1
    steps = np.array(steps[::-1])
    in_a, in_b = np.flatnonzero(steps != 2), np.flatnonzero(steps != 3)
    out = np.zeros((len(steps), LETTERS), np.float32)
    out[in_a] += a
    out[in_b] += b
    return out, in_a, in_b


def merged_all(pairs: list[tuple[np.ndarray, np.ndarray]], scores: np.ndarray, open_: float, extend: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``merged`` of each pair, a row of all pairs of a batch at a time; pairs alike in length are a batch. Long ones are aligned alone."""
    out: list = [None] * len(pairs)
    batches, most, wide = [], 0, 0
    for k in sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1]))):
        m, n = (len(x) for x in pairs[k])
        if not m or not n or 2 * (m + 1) * (n + 1) > TOGETHER:
            out[k] = merged(*pairs[k], scores, open_, extend)
            continue
        most, wide = max(most, m + 1), max(wide, n + 1)
        if not batches or (len(batches[-1]) + 1) * most * wide > TOGETHER:
            batches.append([])
            most, wide = m + 1, n + 1
        batches[-1].append(k)
    for own in batches:
        straight = _straight([pairs[k] for k in own], scores, open_, extend)
        for k in itertools.compress(own, straight):
            a, b = pairs[k]
            out[k] = a + b, np.arange(len(a)), np.arange(len(a))
        rest = [k for k, one in zip(own, straight, strict=True) if not one]
        for k, x in zip(rest, _merged([pairs[k] for k in rest], scores, open_, extend) if rest else [], strict=True):
            out[k] = x
    return out


def _straight(pairs, scores, open_, extend) -> list[bool]:
    """Whether column to column, without gaps, is surely the one best alignment of each pair. Any other of profiles of one length has a gap on
    either side, and its columns score no more than each one's best opposite; where the straight one scores more than that, no recurrence is needed."""
    out = [False] * len(pairs)
    by_length: dict[int, list[int]] = {}
    for k, (a, b) in enumerate(pairs):
        if len(a) == len(b):
            by_length.setdefault(len(a), []).append(k)
    for m, own in by_length.items():
        fa, fb = (np.stack([pairs[k][side] for k in own]) for side in (0, 1))
        for x in (fa, fb):
            x /= np.maximum(x.sum(axis=2).max(axis=1), 1)[:, None, None]
        full_a, full_b = fa.sum(axis=2), fb.sum(axis=2)
        match = fa @ (fb @ scores.T).transpose(0, 2, 1)
        cost = (extend + BESIDE * open_) * (full_a + full_b - 2 * full_a * full_b)
        score = (np.einsum("kii->ki", match) - cost).sum(axis=1)
        most = np.minimum(*(np.maximum(match.max(axis=side), 0).sum(axis=1) for side in (1, 2)))
        other = most - (open_ + extend) * (full_a.min(axis=1) + full_b.min(axis=1))
        for k, one in zip(own, score > other + 1e-3 * (m + most), strict=True):  # a margin many times what sums are rounded by
            out[k] = bool(one)
    return out


def _merged(pairs, scores, open_, extend):
    """The same recurrence as that of ``merged``, over (columns of b, pairs). Cells beyond a pair's own columns never reach those before."""
    size, la, lb = len(pairs), np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    m, n = int(la.max()), int(lb.max())
    fa, fb = np.zeros((size, m, LETTERS), np.float32), np.zeros((size, n, LETTERS), np.float32)
    for k, (a, b) in enumerate(pairs):
        fa[k, : len(a)], fb[k, : len(b)] = a, b
    for x in (fa, fb):
        x /= np.maximum(x.sum(axis=2).max(axis=1), 1)[:, None, None]
    full_a, full_b = np.ascontiguousarray(fa.sum(axis=2).T), np.ascontiguousarray(fb.sum(axis=2).T)
    match = np.ascontiguousarray((fb @ scores.T @ fa.transpose(0, 2, 1)).transpose(2, 1, 0))  # (columns of a, of b, pairs)
    none = np.zeros((1, size), np.float32)
    start, goes_on = np.float32(open_) * full_b, np.concatenate([none, np.cumsum(np.float32(extend) * full_b, axis=0, dtype=np.float32)])
    moves = np.zeros((m + 1, n + 1, size), np.uint8)
    moves[0, 1:], moves[0, 2:] = 2, 6
    h = -start[0] - goes_on
    h[0] = 0
    f, diag, e = (np.full((n + 1, size), _LOW, np.float32) for _ in range(3))
    beside, goes = np.float32(extend + BESIDE * open_), np.zeros((n + 1, size), bool)
    cost, spare = np.empty_like(full_b), np.empty_like(full_b)
    for i in range(1, m + 1):
        own = full_a[i - 1]
        fo = h - np.float32(open_ + extend) * own
        f -= np.float32(extend) * own
        goes_f = f > fo
        np.maximum(fo, f, out=f)
        np.add(full_b, own, out=cost)
        np.multiply(full_b, 2 * own, out=spare)
        cost -= spare
        cost *= beside
        np.add(h[:-1], match[i - 1], out=diag[1:])
        diag[1:] -= cost
        np.maximum(diag, f, out=h)
        np.subtract(h[:-1], start, out=cost)
        cost += goes_on[:-1]
        np.maximum.accumulate(cost, axis=0, out=cost)
        np.subtract(cost, goes_on[1:], out=e[1:])
        np.maximum(h, e, out=h)
        np.subtract(h[:-1], start, out=cost)
        cost += goes_on[:-1]
        cost -= goes_on[1:]
        cost += np.float32(1e-3)
        np.greater(e[1:], cost, out=goes[1:])
        mv = np.where(h == diag, np.uint8(1), np.uint8(3) - (h == e))
        mv |= goes.view(np.uint8) << 2
        mv |= goes_f.view(np.uint8) << 3
        moves[i] = mv
    i, j, state, who = la.copy(), lb.copy(), np.zeros(size, np.uint8), np.arange(size)
    steps = []
    while (i > 0).any() or (j > 0).any():
        mv = moves[i, j, who]
        step = np.where(state > 0, state, np.where((i > 0) & (j > 0), mv & 3, np.where(j > 0, 2, np.where(i > 0, 3, 0)))).astype(np.uint8)
        steps.append(step)
        state = np.where((step == 2) & (mv & 4 > 0) & (j > 1), 2, np.where((step == 3) & (mv & 8 > 0) & (i > 1), 3, 0)).astype(np.uint8)
        i -= (step == 1) | (step == 3)
        j -= (step == 1) | (step == 2)
    way = np.array(steps)[::-1]
    out = []
    for k, (a, b) in enumerate(pairs):
        own = way[:, k]
        own = own[own > 0]
        in_a, in_b = np.flatnonzero(own != 2), np.flatnonzero(own != 3)
        both = np.zeros((len(own), LETTERS), np.float32)
        both[in_a] += a
        both[in_b] += b
        out.append((both, in_a, in_b))
    return out


def progressive(own: list[np.ndarray], protein: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """(profile, places of the columns of each) of profiles that are aligned along their tree."""
    return progressive_all([own], protein)[0]


def progressive_all(groups: list[list[np.ndarray]], protein: bool) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """``progressive`` of each group. Merges of all groups that wait for no other are one step."""
    scores, open_, extend, k = kind(protein)
    places, at, under = [[np.arange(len(p)) for p in own] for own in groups], [list(own) for own in groups], [[[i] for i in range(len(own))] for own in groups]
    levels: list[list[tuple[int, int, int]]] = []
    for g, own in enumerate(groups):
        high = [0] * len(own)
        for i, j in tree([words(p, k) for p in own]) if len(own) > 1 else []:
            level = max(high[i], high[j])
            high[i] = level + 1
            levels += [[] for _ in range(level + 1 - len(levels))]
            levels[level].append((g, i, j))
    for level in levels:
        done = merged_all([(at[g][i], at[g][j]) for g, i, j in level], scores, open_, extend)
        for (g, i, j), (both, left, right) in zip(level, done, strict=True):
            at[g][i], at[g][j] = both, None
            for x, to in ((i, left), (j, right)):
                for y in under[g][x]:
                    places[g][y] = to[places[g][y]]
            under[g][i] += under[g][j]
    return [(own[0], p) for own, p in zip(at, places, strict=True)]
