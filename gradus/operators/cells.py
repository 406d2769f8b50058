"""The best few columns of every row of a block, settled exactly.

Single precision says for every pair of a tile that fits the cache how good it can be at best; only pairs that may still be
among a row's best are worked out in full. Every column is looked at, whatever its place.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

TILE_ROWS = 256
TILE_COLUMNS = 2048
STRIDE = 16  # columns of a tile whose best is found together
SETTLED = 1 << 17  # pairs worked out in full at once

Hopes = Callable[[np.ndarray, int, int, np.ndarray], None]
Scores = Callable[[np.ndarray, np.ndarray], np.ndarray]


def rounding(width: int) -> float:
    """Bound of the error of a single precision product of vectors, relative to the product of their lengths."""
    return (width + 8) * 2.0**-23


def products(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides for single precision products, the columns' side turned."""
    return q.astype(np.float32), np.ascontiguousarray(c.T, dtype=np.float32)


def apart(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors whose single precision product is a number that minus the squared distance of two rows does not exceed."""
    center = y.mean(0) if len(y) else 0.0
    x, y = x - center, y - center
    xx, yy = ((m * m).sum(1, keepdims=True) * (1 - 4 * rounding(m.shape[1])) for m in (x, y))
    left = np.hstack([2 * x, -xx, -np.ones_like(xx)])
    return products(left, np.hstack([y, np.ones_like(yy), yy]))


def places(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each asked key is among unique keys, -1 where it is not."""
    if not len(keys):
        return np.full(len(asked), -1)
    by_key = np.argsort(keys, kind="stable")
    at = by_key[np.minimum(np.searchsorted(keys, asked, sorter=by_key), len(keys) - 1)]
    return np.where(keys[at] == asked, at, -1)


def hide(out: np.ndarray, place: np.ndarray, left: int, right: int) -> None:
    """The one column of every row that does not count, in a tile of columns."""
    rows = np.flatnonzero((place >= left) & (place < right))
    out[rows, place[rows] - left] = -np.inf


def _kept(rows: np.ndarray, columns: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs of every row, ties by the lesser ``tie``."""
    order = np.lexsort((tie[columns], -score, rows))
    rows, columns, score = rows[order], columns[order], score[order]
    near = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[near], columns[near], score[near]


def undominated(x: np.ndarray, tie: np.ndarray, n: int, last: bool) -> np.ndarray:
    """Whether fewer than ``n`` rows equal to a row come before it, with a lesser ``tie``.

    Whoever sees a row sees those before it; with ``last`` whoever sees one sees all, and their place is of no account.
    """
    kept = np.ones(len(x), bool)
    if len(x) <= n:
        return kept
    mark = (x * np.random.default_rng(0).normal(size=x.shape[1])).sum(1)
    # Rows that only share their mark make a group end early, which keeps more rows and never too few.
    order = np.lexsort((tie, mark)) if last else np.argsort(mark, kind="stable")
    starts = np.flatnonzero(np.append(True, (x[order[1:]] != x[order[:-1]]).any(1)))
    sizes = np.diff(np.append(starts, len(x)))
    if last:
        kept[order] = np.arange(len(x)) - np.repeat(starts, sizes) < n
        return kept
    for i in np.flatnonzero(sizes > n):
        least: list[int] = []  # negated, so that the greatest of the n least is on top
        for row in order[starts[i] : starts[i] + sizes[i]]:
            if len(least) < n:
                heapq.heappush(least, -tie[row])
            elif tie[row] < -least[0]:
                heapq.heapreplace(least, -tie[row])
            else:
                kept[row] = False
    return kept


def best_columns(
    n_rows: int, n_columns: int, k: int, hopes: Hopes, scores: Scores, tie: np.ndarray,
    first: np.ndarray | None = None, floor: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column numbers and scores of the k best pairs per row, ties by ``tie``.

    ``hopes(rows, left, right, out)`` writes for given rows and columns ``left`` to ``right`` a number that no score exceeds,
    -inf for pairs that do not count; ``scores(rows, columns)`` works out single pairs. Of a row only the ``first`` columns
    count, and only scores of at least its ``floor`` are wanted.
    """
    first = np.full(n_rows, n_columns) if first is None else first
    order = np.argsort(-first, kind="stable")
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    tile = np.empty((TILE_ROWS, TILE_COLUMNS), np.float32)
    for start in range(0, n_rows, TILE_ROWS):
        rows = order[start : start + TILE_ROWS]
        most, least = first[rows[0]], first[rows[-1]]
        limit = np.full(len(rows), -np.inf) if floor is None else floor[rows].astype(np.float64)
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def settle(r: np.ndarray, c: np.ndarray, kept=kept, rows=rows):
            for at in range(0, len(r), SETTLED):
                part = slice(at, at + SETTLED)
                score = scores(rows[r[part]], c[part])
                good = np.isfinite(score)
                joined = [np.concatenate(pair) for pair in zip(kept, (r[part][good], c[part][good], score[good]))]
                kept = _kept(*joined, tie, k)
            return kept

        for left in range(0, most, TILE_COLUMNS):
            right = min(left + TILE_COLUMNS, most)
            wide = -(-(right - left) // STRIDE)
            out = tile.reshape(-1)[: len(rows) * wide * STRIDE].reshape(len(rows), wide * STRIDE)
            out[:, right - left :] = -np.inf
            hopes(rows, left, right, out[:, : right - left])
            if right > least:
                out[:, : right - left][np.arange(left, right)[None, :] >= first[rows][:, None]] = -np.inf
            folded = out.reshape(len(rows), STRIDE, wide)
            top = folded.max(axis=1)
            if k < wide and len(kept[0]) == 0:
                # Pairs that look best settle a limit that few others reach.
                near = np.partition(top, wide - k, axis=1)[:, wide - k].astype(np.float64)
                r, g = np.nonzero((top >= np.maximum(limit, near)[:, None]) & (top > -np.inf))
                s = folded[r, :, g].argmax(1)
                tried = settle(r, left + s * wide + g, kept)
                limit = _limits(limit, tried, k)
            r, g = np.nonzero((top >= limit[:, None]) & (top > -np.inf))
            if len(r):
                i, s = np.nonzero((folded[r, :, g] >= limit[r][:, None]) & (folded[r, :, g] > -np.inf))
                kept = settle(r[i], left + s * wide + g[i], kept)
                limit = _limits(limit, kept, k)
        found.append((rows[kept[0]], kept[1], kept[2]))
    r, c, score = (np.concatenate(part) for part in zip(*found))
    return r, c, score


def _limits(limit: np.ndarray, kept: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The k-th best score of rows that have k."""
    rows, _, score = kept
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    out = limit.copy()
    full = place == k - 1
    out[rows[full]] = np.maximum(out[rows[full]], score[full])
    return out
