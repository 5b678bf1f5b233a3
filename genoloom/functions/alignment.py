"""Pairwise alignment of many proteins at once, in numpy: affine gaps, local or global, by anti-diagonals."""

from __future__ import annotations

import math

import numpy as np

# BLOSUM62, lower triangle, and the Karlin-Altschul constants for gaps of 11 + 1 a residue.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
OPEN, EXTEND, LAMBDA, K = 11, 1, 0.267, 0.041
#: Bytes of the moves of pairs that are aligned at once.
CELLS = 1 << 27
_LOW = -(10**6)


def matrix() -> np.ndarray:
    """Scores by byte; whatever isn't a residue scores -1 against all."""
    out = np.full((256, 256), -1, np.int32)
    for i, row in enumerate(BLOSUM62.split("\n")[1:-1]):
        for j, s in enumerate(map(int, row.split())):
            for a, b in ((i, j), (j, i)):
                out[ord(RESIDUES[a]), ord(RESIDUES[b])] = s
    return out


def identity_matrix(match: int = 2, mismatch: int = -1) -> np.ndarray:
    out = np.full((256, 256), mismatch, np.int32)
    np.fill_diagonal(out, match)
    return out


SCORES = matrix()


def aligned(pairs: list[tuple[bytes, bytes]], local: bool = True, scores: np.ndarray = SCORES, open_: int = OPEN, extend: int = EXTEND) -> list[tuple[int, list[tuple[int, int]]]]:
    """(score, path) of each pair; a path is the aligned places (i, j), -1 for a gap, in order."""
    if not pairs:
        return []
    n_pairs, m, n = len(pairs), max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    if n_pairs > 1 and n_pairs * (m + 1) * (m + n + 1) > CELLS:
        half = n_pairs // 2
        return [x for own in (pairs[:half], pairs[half:]) for x in aligned(own, local, scores, open_, extend)]
    la, lb = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    q, t = np.zeros((n_pairs, m + 1), np.uint8), np.zeros((n_pairs, n + 1), np.uint8)
    for k, (a, b) in enumerate(pairs):
        q[k, 1 : len(a) + 1], t[k, 1 : len(b) + 1] = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    # by anti-diagonal d = i + j, indexed by i
    shape = (n_pairs, m + 1)
    h2, h1 = np.full(shape, _LOW, np.int32), np.full(shape, _LOW, np.int32)
    e1, f1 = np.full(shape, _LOW, np.int32), np.full(shape, _LOW, np.int32)
    moves = np.zeros((m + n + 1, *shape), np.uint8)  # 1 diagonal, 2 gap in q, 3 gap in t; 4: the gap in q goes on; 8: that in t does
    best, where = np.full(n_pairs, 0 if local else _LOW, np.int64), np.zeros((n_pairs, 2), np.int64)
    h1[:, 0] = 0  # d = 0
    for d in range(1, m + n + 1):
        lo, hi = max(0, d - n), min(m, d)
        h, e, f = (np.full(shape, _LOW, np.int32) for _ in range(3))
        i = np.arange(lo, hi + 1)
        ii = slice(lo, hi + 1)
        # from (i, j-1) and from (i-1, j)
        eo, ee = h1[:, ii] - open_ - extend, e1[:, ii] - extend
        e[:, ii] = np.maximum(eo, ee)
        up = slice(max(lo, 1), hi + 1)
        down = slice(max(lo, 1) - 1, hi)
        f[:, up] = np.maximum(h1[:, down] - open_ - extend, f1[:, down] - extend)
        go_f = np.zeros(shape, bool)
        go_f[:, up] = f1[:, down] - extend > h1[:, down] - open_ - extend
        e[:, i[d - i < 1]] = _LOW
        diag = np.full(shape, _LOW, np.int32)
        inner = i[(i >= 1) & (d - i >= 1)]
        if len(inner):
            diag[:, inner] = h2[:, inner - 1] + scores[q[:, inner], t[:, d - inner]]
        h = np.maximum(np.maximum(diag, e), f)
        mv = np.where(h == diag, 1, np.where(h == e, 2, 3)).astype(np.uint8)
        if local:
            edge = i[(i == 0) | (d - i == 0)]
            mv[h <= 0] = 0
            h = np.maximum(h, 0)
            h[:, edge] = 0
            mv[:, edge] = 0
            outside = np.ones(m + 1, bool)
            outside[ii] = False
            h[:, outside] = _LOW
        mv[:, ii] |= (ee > eo).astype(np.uint8) * 4
        mv |= go_f.astype(np.uint8) * 8
        moves[d] = mv
        ok = (i[None, :] <= la[:, None]) & (d - i[None, :] <= lb[:, None])
        if local:
            v = np.where(ok, h[:, ii], -1)
            k = v.argmax(axis=1)
            top = v[np.arange(n_pairs), k]
            new = top > best
            best[new] = top[new]
            where[new] = np.stack([i[k], d - i[k]], 1)[new]
        else:
            at = np.flatnonzero(la + lb == d)
            best[at] = h[at, la[at]]
            where[at] = np.stack([la[at], lb[at]], 1)
        h2, h1, e1, f1 = h1, h, e, f
    out = []
    for k in range(n_pairs):
        i, j = where[k].tolist()
        path, state = [], 0
        while i or j:
            mv = int(moves[i + j, k, i])
            if state == 0:
                step = mv & 3
                if step == 0 and local:
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
        out.append((int(best[k]), path[::-1]))
    return out


def hit(a: bytes, b: bytes, score: int, path: list, database: int) -> tuple:
    """pident, length, mismatch, gapopen, qstart, qend, sstart, send, evalue, bitscore of a local alignment (places from 1)."""
    same = sum(i >= 0 and j >= 0 and a[i] == b[j] for i, j in path)
    both = sum(i >= 0 and j >= 0 for i, j in path)
    gaps, last = 0, 0
    for i, j in path:
        kind = 1 if i < 0 else 2 if j < 0 else 0
        gaps += bool(kind) and kind != last
        last = kind
    qs, ss = [i for i, _ in path if i >= 0], [j for _, j in path if j >= 0]
    bits = (LAMBDA * score - math.log(K)) / math.log(2)
    return 100.0 * same / len(path), len(path), both - same, gaps, qs[0] + 1, qs[-1] + 1, ss[0] + 1, ss[-1] + 1, K * len(a) * database * math.exp(-LAMBDA * score), bits


def whole_hit(a: bytes, database: int) -> tuple | None:
    """``hit`` of a sequence against itself, which scores nowhere as much as from end to end; None where letters aren't residues."""
    if not a or a.translate(None, RESIDUES.encode()):
        return None
    x = np.frombuffer(a, np.uint8)
    score, n = int(SCORES[x, x].sum()), len(a)
    return 100.0, n, 0, 0, 1, n, 1, n, K * n * database * math.exp(-LAMBDA * score), (LAMBDA * score - math.log(K)) / math.log(2)
