import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.operators.assignment import assign
from shelfmark.operators.solver import solve


@pytest.mark.parametrize(
    "s,order",
    [([[0, 5, 1], [1, 0, 4], [2, 1, 0]], [0, 1, 2]), ([[0, 1, 2], [5, 0, 1], [1, 4, 0]], [2, 1, 0]), ([[0, 1], [1, 0]], [0, 1])],
)
def test_goldens(s, order):
    assert solve(np.array(s, float)) == order


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 6), st.integers(0, 10_000))
def test_assignment_is_optimal(n, seed):
    r = np.random.RandomState(seed)
    cost = r.randint(0, 9, (n, n)).astype(float)
    np.fill_diagonal(cost, np.inf)
    best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
    a = assign(cost)
    assert sorted(a) == list(range(n)) and sum(cost[i, a[i]] for i in range(n)) == best


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10_000))
def test_orders_are_permutations(n, seed):
    r = np.random.RandomState(seed)
    s = r.rand(n, n) * (r.rand(n, n) < 0.5)
    np.fill_diagonal(s, 0)
    assert sorted(solve(s)) == list(range(n))


def test_many_chains_are_merged():
    s = np.zeros((300, 300))
    for k in range(0, 300, 2):
        s[k, k + 1] = s[k + 1, k] = 1 + k / 1000
    order = solve(s)
    assert sorted(order) == list(range(300))
    at = {x: p for p, x in enumerate(order)}
    assert all(abs(at[k] - at[k + 1]) == 1 for k in range(0, 300, 2))


def test_no_assignment():
    with pytest.raises(ValueError):
        assign(np.array([[np.inf]]))
