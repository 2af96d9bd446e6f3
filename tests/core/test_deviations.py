"""Marginal deviations from entries, without a matrix of all teams."""

import numpy as np
import pytest
from duelframe.plans import posterior


def entries(n, parts, seed=3):
    """A Hessian of parts that no match ties, each of them tied whole."""
    rng = np.random.default_rng(seed)
    out = np.diag(rng.uniform(1e-4, 1e-3, n))
    for _ in range(6 * n):
        a = rng.integers(n)
        b = (a + parts * rng.integers(1, n)) % n if n % parts == 0 else a
        if a != b:
            h = rng.uniform(0, 5e-4)
            out[[a, b], [a, b]] += h
            out[[a, b], [b, a]] -= h
    return (*np.nonzero(out), out[np.nonzero(out)], out)


@pytest.mark.parametrize("parts", [1, 4, 12])
@pytest.mark.parametrize("whole", [4000, 10])
def test_parts_and_columns_equal_the_whole_matrix(parts, whole):
    row, column, value, matrix = entries(96, parts)
    shuffled = np.random.default_rng(1).permutation(len(row))
    got = posterior.sparse_sd(row[shuffled], column[shuffled], value[shuffled], 96, whole)
    assert got == pytest.approx(posterior.marginal_sd(np.linalg.cholesky(matrix)), rel=1e-10)


def test_many_teams_need_no_matrix_of_them_all():
    n = 200_000  # 320 GB as a matrix
    a = np.arange(0, n, 2)
    row, column = np.concatenate([np.arange(n), a, a + 1]), np.concatenate([np.arange(n), a + 1, a])
    value = np.concatenate([np.full(n, 2.0), np.full(n, -1.0)])
    assert posterior.sparse_sd(row, column, value, n) == pytest.approx(np.sqrt(2 / 3))


def hessian(n, links, weight, seed=5):
    """Entries of n teams with random matches, as many times n."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(n, size=(2, int(links * n)))
    a, b = np.unique(np.sort(np.stack((a, b)), axis=0), axis=1)
    a, b = a[a != b], b[a != b]
    h = rng.uniform(0, weight, len(a)) * 8e-6
    diagonal = 1 / 2500 + np.bincount(a, h, n) + np.bincount(b, h, n)
    return np.concatenate((np.arange(n), a, b)), np.concatenate((np.arange(n), b, a)), np.concatenate((diagonal, -h, -h))


def test_tied_teams_are_not_solved_for_all_together(monkeypatch):
    n = 30_000  # one part: 1.6 matches a team
    row, column, value = hessian(n, 1.6, 1.5)
    asked = np.arange(0, n, n // 8)
    want = posterior._solved_sd(row, column, value, n, asked)
    monkeypatch.setattr(posterior, "_solved_sd", None)
    got = posterior.sparse_sd(row, column, value, n)
    assert got[asked] == pytest.approx(want, rel=1e-12) and np.isfinite(got).all()


@pytest.mark.parametrize(("links", "weight"), [(1.2, 1), (3, 200), (20, 1), (3, 1e5)])
@pytest.mark.parametrize("step", [50, 1_000_000])
def test_walks_equal_the_whole_matrix_or_leave_it(monkeypatch, links, weight, step):
    n = 600
    monkeypatch.setattr(posterior, "STEP", step)
    row, column, value = hessian(n, links, weight)
    matrix = np.zeros((n, n))
    matrix[row, column] = value
    want = posterior.marginal_sd(np.linalg.cholesky(matrix))
    got, left = posterior._local_sd(row, column, value, n)
    kept = np.setdiff1d(np.arange(n), left)
    assert got[kept] == pytest.approx(want[kept], rel=1e-12) and (len(kept) if weight == 1 and links < 2 else len(left))
    for whole in (4000, 10):
        assert posterior.sparse_sd(row, column, value, n, whole) == pytest.approx(want, rel=1e-10)
