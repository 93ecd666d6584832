"""Array kernels of the neighbour graph: quantised vectors, list merging, local joins and scoring within a block of nodes.

Nothing here knows Spark. A node's code is its place in its block times the number of blocks, plus the block."""

from __future__ import annotations

import numpy as np

#: Bytes before a quantised row's signed components: the scale (float32) and the band (int32).
HEAD = 8


def exponents(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (unit rows) and base-2 logarithms of the norms, for any finite non-zero rows."""
    m = np.abs(x).max(1, keepdims=True)
    r = x / m
    n = np.sqrt((r * r).sum(1, keepdims=True))
    return r / n, (np.log2(m) + np.log2(n))[:, 0]


def quantised(x: np.ndarray, greatest: float) -> np.ndarray:
    """Rows of bytes: scale, band, and the components with one more that makes all norms of a band's rows 1. Bands are
    halvings of the greatest norm (its base-2 logarithm is given), so that no norm flattens the others."""
    unit, log = exponents(x)
    down = np.maximum(0.0, greatest - log)
    band = np.floor(down + 1e-9)
    rel = np.minimum(1.0, np.exp2(band - down))
    y = np.column_stack((unit * rel[:, None], np.sqrt(np.maximum(0.0, 1 - rel * rel))))
    scale = (np.abs(y).max(1, keepdims=True) / 127).astype(np.float32)
    q = np.rint(y / scale).astype(np.int8)
    return np.concatenate((scale.view(np.uint8), band.astype(np.int32)[:, None].view(np.uint8), q.view(np.uint8)), axis=1)


def parts_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scale, band and components (whole numbers, as float32) of quantised rows."""
    rows = np.ascontiguousarray(rows)
    return np.ascontiguousarray(rows[:, :4]).view(np.float32)[:, 0], np.ascontiguousarray(rows[:, 4:8]).view(np.int32)[:, 0], rows[:, HEAD:].view(np.int8).astype(np.float32)


def best_of(target: np.ndarray, cand: np.ndarray, s: np.ndarray, k: int, rank: np.ndarray | None = None):
    """Indices of each target's k best distinct candidates, best first, ties to the smaller candidate. Of a repeated
    candidate the row with the least rank (else the best) stays."""
    order = np.lexsort((-s, rank if rank is not None else np.zeros(len(s), np.int8), cand, target))
    t, c = target[order], cand[order]
    first = np.ones(len(order), bool)
    first[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
    order = order[first]
    order = order[np.lexsort((cand[order], -s[order], target[order]))]
    t = target[order]
    start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, int)
    place = np.arange(len(t)) - np.repeat(start, np.diff(np.append(start, len(t))))
    return order[place < k]


def listed(n: int, k: int, target: np.ndarray, *columns: tuple[np.ndarray, object]) -> list[np.ndarray]:
    """Rows sorted by target as n rows of k places; each column comes with the value of empty places."""
    start = np.searchsorted(target, np.arange(n))
    place = np.arange(len(target)) - start[target] if len(target) else np.zeros(0, int)
    out = []
    for values, empty in columns:
        a = np.full((n, k), empty, values.dtype)
        a[target, place] = values
        out.append(a)
    return out


def merged(n: int, k: int, lists: np.ndarray, s: np.ndarray, target: np.ndarray, cand: np.ndarray, score: np.ndarray):
    """Lists with offers merged in: codes, similarities, and marks of what is new."""
    have = lists >= 0
    t = np.concatenate((np.nonzero(have)[0], target))
    c = np.concatenate((lists[have], cand))
    v = np.concatenate((s[have], score)).astype(np.float32)
    new = np.concatenate((np.zeros(int(have.sum()), np.int8), np.ones(len(cand), np.int8)))
    i = best_of(t, c, v, k, new)
    return listed(n, k, t[i], (c[i], -1), (v[i], np.float32(-9)), (new[i], 0))


def local_join(lists, new, rev, rev_new, codes, rows, low, k, least=2_000_000):
    """Compares every node's listed and reverse neighbours among each other, pairs of which one is new; yields
    (targets, candidates, similarities) of pairs that beat the target's worst, at most the k best a target each time.
    codes (sorted), rows and low describe the nodes that occur."""
    scale, band, x = parts_of(rows)
    ids = np.concatenate((lists, rev), axis=1)
    fresh = np.concatenate((new, rev_new), axis=1).astype(bool)
    work = np.flatnonzero(fresh.any(1))
    held: list = []
    n = 0
    for i in range(0, len(work), 128):
        w = work[i : i + 128]
        c = ids[w]
        ok = c >= 0
        at = np.searchsorted(codes, np.where(ok, c, codes[0]))
        f = fresh[w] & ok
        y = x[at]
        sim = np.matmul(y, y.transpose(0, 2, 1))
        sc = scale[at]
        sim *= sc[:, :, None] * sc[:, None, :]
        good = (f[:, :, None] | f[:, None, :]) & ok[:, :, None] & ok[:, None, :] & (sim > low[at][:, :, None]) & (c[:, :, None] != c[:, None, :])
        a, p, q = np.nonzero(good)
        held.append((c[a, p], c[a, q], sim[a, p, q]))
        n += len(a)
        if n > least:
            t, u, v = (np.concatenate(z) for z in zip(*held, strict=True))
            j = best_of(t, u, v, k)
            held, n = [(t[j], u[j], v[j])], len(j)
            if n > least // 2:
                yield held[0]
                held, n = [], 0
    if n:
        t, u, v = (np.concatenate(z) for z in zip(*held, strict=True))
        j = best_of(t, u, v, k)
        yield t[j], u[j], v[j]


def leaf_lists(codes: np.ndarray, rows: np.ndarray, k: int):
    """The k best neighbours of each of a leaf's nodes within it: targets, candidates, similarities."""
    scale, band, x = parts_of(rows)
    s = (x @ x.T) * (scale[:, None] * scale)
    s[band[:, None] != band] = -9
    np.fill_diagonal(s, -9)
    n = min(k, len(codes) - 1)
    if n < 1:
        return codes[:0], codes[:0], np.zeros(0, np.float32)
    top = np.argpartition(-s, n - 1, axis=1)[:, :n]
    v = np.take_along_axis(s, top, 1).ravel().astype(np.float32)
    ok = v > -5
    return np.repeat(codes, n)[ok], codes[top].ravel()[ok], v[ok]
