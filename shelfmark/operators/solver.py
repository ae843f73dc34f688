"""A heavy Hamiltonian path through a repository's files.

A perfect assignment gives every file a successor; its cycles are cut at their lightest edge
into chains, chains are assigned to each other until few are left, and those are joined
greedily, the heaviest connection first. Ties go to the smallest index.

The matrix is built beside the solver, from the terms' and the importers' lists of a repository;
it is the only square one, holds 4 bytes an entry, and turns into the cost matrix in place.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa

from shelfmark.operators.assignment import assign

ROUNDS = 10
FEW = 64
SMALL, FLOOR = 10, 0.01


def oriented(nodes: list[int], cost: np.ndarray) -> list[int]:
    """A chain in the direction of the lesser cost; forward if both are equal.

    The smaller end counts as the beginning.
    """
    if nodes[0] > nodes[-1]:
        nodes = nodes[::-1]
    a, b = np.array(nodes[:-1], dtype=int), np.array(nodes[1:], dtype=int)
    return nodes if cost[a, b].sum(dtype=float) <= cost[b, a].sum(dtype=float) else nodes[::-1]


def chains_of(successor: dict[int, int], cost: np.ndarray) -> list[list[int]]:
    """Components of a successor map as chains; a cycle loses its lightest edge (the first of equals)."""
    heads = sorted(set(successor) - set(successor.values()))
    seen: set[int] = set()
    out = []
    for start in [*heads, *sorted(successor)]:
        if start in seen:
            continue
        walk = [start]
        seen.add(start)
        while (n := successor.get(walk[-1])) is not None and n not in seen:
            walk.append(n)
            seen.add(n)
        if successor.get(walk[-1]) == start and len(walk) > 1:
            k = int(np.argmax(cost[walk, walk[1:] + walk[:1]]))
            walk = walk[k + 1 :] + walk[: k + 1]
        out.append(oriented(walk, cost) if len(walk) > 1 else walk)
    return out


def joined(chains: list[list[int]], cost: np.ndarray) -> list[int]:
    """All chains as one, by repeated choice of the cheapest end-to-start connection."""
    alive = {k: c for k, c in enumerate(chains)}
    key = lambda k: (alive[k][0], alive[k][-1], tuple(alive[k]))
    heap = [(cost[a[-1], b[0]], (a[0], a[-1], tuple(a)), (b[0], b[-1], tuple(b)), x, y) for x, a in alive.items() for y, b in alive.items() if x != y]
    heapq.heapify(heap)
    fresh = len(chains)
    while len(alive) > 1:
        _, _, _, x, y = heapq.heappop(heap)
        if x not in alive or y not in alive:
            continue
        alive[fresh] = alive.pop(x) + alive.pop(y)
        for k in alive:
            if k != fresh:
                a, b = alive[fresh], alive[k]
                heapq.heappush(heap, (cost[a[-1], b[0]], key(fresh), key(k), fresh, k))
                heapq.heappush(heap, (cost[b[-1], a[0]], key(k), key(fresh), k, fresh))
        fresh += 1
    return next(iter(alive.values()))


def solve(s: np.ndarray) -> list[int]:
    """An order of the rows of a square matrix of similarities."""
    if s.shape[0] != s.shape[1]:
        raise ValueError("the matrix must be square")
    return path_of(-s.astype(float))


def path_of(cost: np.ndarray) -> list[int]:
    """An order of the rows of a matrix of costs, which is changed: pairs that may not meet become inf."""
    n = cost.shape[0]
    if n <= 1:
        return list(range(n))
    np.fill_diagonal(cost, np.inf)
    chains = chains_of(dict(enumerate(assign(cost).tolist())), cost)
    barred: dict[tuple[int, int], float] = {}
    for _ in range(ROUNDS):
        if len(chains) <= FEW:
            break
        for c in chains:
            for x, y in ((c[0], c[-1]), (c[-1], c[0])):
                barred.setdefault((x, y), float(cost[x, y]))
                cost[x, y] = np.inf
        starts, ends = np.array([c[0] for c in chains]), np.array([c[-1] for c in chains])
        to = assign(cost[np.ix_(ends, starts)])
        step = {int(ends[k]): int(starts[t]) for k, t in enumerate(to)}
        for c in chains:
            step.update(zip(c[:-1], c[1:]))
        # the edges inside chains keep their weights
        now = {e: cost[e] for e in barred}
        for e, w in barred.items():
            if e[0] != e[1]:
                cost[e] = w
        chains = chains_of(step, cost)
        for e, w in now.items():
            cost[e] = w
    return joined(chains, cost)


def similarities(n: int, lists: list[tuple[np.ndarray, np.ndarray]], block: int = 2048) -> np.ndarray:
    """S from the terms' lists of (documents, weights): S[i, j] adds up the weights in j of i's terms.

    Terms of many documents are multiplied as dense blocks, the others added list by list.
    """
    s = np.zeros((n, n), dtype=np.float32)
    many = [x for x in lists if len(x[0]) > 64 and len(x[0]) * 8 > n]
    for at in range(0, len(many), block):
        some = many[at : at + block]
        has, w = np.zeros((n, len(some)), dtype=np.float32), np.zeros((len(some), n), dtype=np.float32)
        for k, (docs, weights) in enumerate(some):
            has[docs, k] = 1
            w[k, docs] = weights
        s += has @ w
    for docs, weights in lists:
        if not (len(docs) > 64 and len(docs) * 8 > n):
            s[np.ix_(docs, docs)] += weights.astype(np.float32)
    return s


def scale_of(s: np.ndarray) -> float:
    """The largest entry of small matrices, else the 95th percentile of all entries (linear); at least a hundredth."""
    n = s.shape[0]
    if n < SMALL:
        return max(FLOOR, float(s.max()))
    at = 0.95 * (n * n - 1)
    values = s[s > 0]
    lo, hi = int(at) - (n * n - len(values)), int(np.ceil(at)) - (n * n - len(values))
    if hi < 0:
        return FLOOR
    values.partition(sorted({max(lo, 0), hi}))
    a, b = (float(values[lo]) if lo >= 0 else 0.0), float(values[hi])
    return max(FLOOR, a + (b - a) * (at - int(at)))


def connections(n: int, hubs: list[tuple[int | None, np.ndarray, np.ndarray, np.ndarray]], sibling: float = 0.5, decay: float = 0.25) -> dict[int, float]:
    """G as {i * n + j: weight}: imports, a quarter of them backwards, and siblings in both directions.

    Of every hub its importers are siblings of each other, by edges: a repeated edge makes repeated pairs.
    """
    at: list[np.ndarray] = []
    values: list[np.ndarray] = []
    for i, to, weights, back in hubs:
        if i is not None:
            at += [i * n + to, to * n + i]
            values += [weights, decay * back]
        own = to if i is None else to[to != i]
        if len(own) > 1:
            x, y = np.nonzero(~np.eye(len(own), dtype=bool))
            at.append(own[x] * n + own[y])
            values.append(np.full(len(x), sibling))
    if not at:
        return {}
    keys, where = np.unique(np.concatenate(at), return_inverse=True)
    return dict(zip(keys.tolist(), np.bincount(where, np.concatenate(values)).tolist()))


def step_scores(n: int, lists: list[tuple[np.ndarray, np.ndarray]], a: list[int], b: list[int]) -> list[float]:
    """S[a, b] of some pairs, from the terms that both files have: neither boosted nor barred."""
    docs = np.concatenate([d for d, _ in lists])
    terms = np.repeat(np.arange(len(lists)), [len(d) for d, _ in lists])
    by = np.argsort(docs, kind="stable")
    weights, terms = np.concatenate([w for _, w in lists])[by], terms[by]
    end = np.searchsorted(docs[by], np.arange(n), side="right")
    start = np.concatenate(([0], end[:-1]))
    out = []
    for x, y in zip(a, b):
        own, other = terms[start[x] : end[x]], terms[start[y] : end[y]]
        out.append(float(weights[start[y] : end[y]][np.isin(other, own, assume_unique=True)].sum()))
    return out


ORDER = "repo_id string, pos int, idx int, solved boolean, has_s boolean, matching_score double"
KINDS = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.float64()]


def orderer(boost: float):
    """Grouped-map body: the order of one repository.

    Its rows are (repo_id, n, at, to, weights, back): one with its size, one for each term with
    the documents and their weights (``back`` null), and one for each file that others import.
    Two files have all similarities one and no scores. A repository without terms is ordered by
    its connections; an unsolvable matrix gives path order and ``solved`` = False.
    """

    def run(table: pa.Table) -> pa.Table:
        repo = table["repo_id"][0].as_py()
        sizes, hub_at = table["n"].to_pylist(), table["at"].to_pylist()
        n = max((x for x in sizes if x is not None), default=0)
        lists, hubs = [], []
        flat = {}
        for c in ("to", "weights", "back"):
            whole = table[c].combine_chunks()
            whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
            flat[c] = (whole.offsets.to_numpy(), whole.values.to_numpy(zero_copy_only=False), whole.is_valid().to_numpy(zero_copy_only=False))
        for r in range(table.num_rows):
            part = {c: (v[o[r] : o[r + 1]] if ok[r] else None) for c, (o, v, ok) in flat.items()}
            if part["to"] is None:
                continue
            if part["back"] is None:
                lists.append((part["to"], part["weights"]))
            else:
                hubs.append((hub_at[r], part["to"].astype(np.int64), part["weights"], part["back"]))
        s = np.ones((n, n), dtype=np.float32) if n == 2 else similarities(n, lists)
        has_s = n == 2 or bool(lists)
        scale = (scale_of(s) if has_s else 1.0) * boost if has_s else 1.0
        links = connections(n, hubs)
        keys = np.fromiter(links, dtype=np.int64, count=len(links))
        s.ravel()[keys] += np.fromiter(links.values(), dtype=np.float64, count=len(links)) * scale
        cost = np.negative(s, out=s)
        try:
            order, solved = path_of(cost), True
        except ValueError:
            order, solved = list(range(n)), False
        scores: list[float | None] = [None] * n
        if solved and has_s and n > 2:
            scores = step_scores(n, lists, order, [*order[1:], order[-2]])
        cols = [[repo] * n, list(range(n)), order, [solved] * n, [has_s] * n, scores]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS)], names=["repo_id", "pos", "idx", "solved", "has_s", "matching_score"])

    return run
