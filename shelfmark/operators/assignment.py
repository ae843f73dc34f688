"""Least-cost perfect assignment by shortest augmenting paths (numpy only)."""

from __future__ import annotations

import numpy as np


def _reduced(cost: np.ndarray, u: np.ndarray, v: np.ndarray, row_of: np.ndarray, col_of: np.ndarray) -> None:
    """Rows bid for their cheapest column, as long as that leaves them content.

    A row takes its best column and lowers the column's price to that of its second best; a row
    that loses its column bids again. Few rows remain for the search of paths.
    """
    n = len(u)
    for _ in range(2):
        todo = np.flatnonzero(col_of < 0).tolist()[::-1]
        left = 8 * len(todo) + 8  # equal prices could pass a column on for ever
        while todo and left:
            left -= 1
            i = todo.pop()
            row = cost[i] - v
            j = int(row.argmin())
            low = row[j]
            if not np.isfinite(low):
                raise ValueError("a row has no allowed column")
            row[j] = np.inf
            k = int(row.argmin()) if n > 1 else j
            second = row[k]
            if low < second and np.isfinite(second):
                v[j] -= second - low
            elif row_of[j] >= 0 and low == second:
                j = k
            old = row_of[j]
            if old >= 0 and not low < second:
                continue  # no gain in taking it away
            row_of[j], col_of[i] = i, j
            if old >= 0:
                col_of[old] = -1
                todo.append(int(old))


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a perfect assignment of least cost; ``inf`` forbids a pair.

    Dual variables keep reduced costs non-negative; each row is added along a shortest
    alternating path. Among equal distances a free column comes first, then the smallest, so results
    are deterministic. ``cost`` is only read, one row at a time, and never copied. Raises ValueError
    if there is no assignment.
    """
    n = cost.shape[0]
    u = np.zeros(n)
    row_of = np.full(n, -1)
    col_of = np.full(n, -1)
    if not n:
        return col_of
    low = cost.min(axis=0).astype(float)
    v = np.where(np.isfinite(low), low, 0.0)
    for i in range(n):  # rows whose best column is still free
        j = int((cost[i] - v).argmin())
        if row_of[j] < 0:
            row_of[j], col_of[i] = i, j
    _reduced(cost, u, v, row_of, col_of)
    for i in range(n):
        u[i] = (cost[i] - v).min()
    if not np.isfinite(u).all():
        raise ValueError("a row has no allowed column")
    free = np.flatnonzero(row_of < 0)
    for start in np.flatnonzero(col_of < 0):
        dist = np.full(n, np.inf)
        open_ = np.full(n, np.inf)  # dist of the columns that are not done
        before = np.full(n, -1)
        done = np.zeros(n, dtype=bool)
        i, so_far, end = start, 0.0, -1
        scanned = []
        while end < 0:
            step = cost[i] - v
            step += so_far - u[i]
            closer = step < open_
            closer &= ~done
            dist[closer] = open_[closer] = step[closer]
            before[closer] = i
            j = int(open_.argmin())
            so_far = open_[j]
            k = int(free[open_[free].argmin()])
            if open_[k] == so_far:
                j = k  # as near, and the path ends there
            if not np.isfinite(so_far):
                raise ValueError("no perfect assignment")
            done[j] = True
            open_[j] = np.inf
            scanned.append(j)
            if row_of[j] < 0:
                end = j
            else:
                i = row_of[j]
        cols = np.array(scanned[:-1], dtype=int)
        u[start] += so_far
        if len(cols):
            u[row_of[cols]] += so_far - dist[cols]
            v[cols] -= so_far - dist[cols]
        free = free[free != end]
        j = end
        while True:
            i = before[j]
            row_of[j] = i
            col_of[i], j = j, col_of[i]
            if i == start:
                break
    return col_of
