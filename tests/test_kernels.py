"""Algebraic checks of the per-target solvers."""

import numpy as np
import pytest

from recjobs.functions.kernels import enet_gram, logistic_newton, lottery_merge, ridge_gram, svm_squared_hinge
from recjobs.operators.hybrid import draws


@pytest.fixture()
def ratings():
    rng = np.random.default_rng(0)
    return rng.integers(0, 4, (60, 12)) * (rng.random((60, 12)) < 0.4) * 1.0


def test_ridge_equals_the_closed_form(ratings):
    """A column zeroed and regressed on the others: -P_ij / P_jj with P the inverse of G + aI."""
    g, alpha = ratings.T @ ratings, 3.0
    p = np.linalg.inv(g + alpha * np.eye(12))
    for j in range(12):
        others = [i for i in range(12) if i != j]
        w = ridge_gram(g[np.ix_(others, others)], g[others, j], alpha)
        assert np.allclose(w, -p[others, j] / p[j, j])


def test_one_feature_ridge():
    assert ridge_gram(np.array([[8.0]]), np.array([6.0]), 4.0) == pytest.approx([0.5])


@pytest.mark.parametrize("positive", [True, False])
@pytest.mark.parametrize("ratio", [1.0, 0.3])
def test_elastic_net_is_optimal(ratings, positive, ratio):
    g, n, alpha = ratings.T @ ratings, 60, 0.05
    a, c = g[1:, 1:], g[1:, 0]
    w = enet_gram(a, c, n, alpha, ratio, positive, steps=20_000, tolerance=1e-13)
    slope = (a @ w - c) / n + alpha * (1 - ratio) * w
    assert np.allclose(slope[w > 0], -alpha * ratio, atol=1e-7)
    if positive:
        assert (w >= 0).all() and (slope[w == 0] >= -alpha * ratio - 1e-7).all()
    else:
        assert np.allclose(slope[w < 0], alpha * ratio, atol=1e-7) and (np.abs(slope[w == 0]) <= alpha * ratio + 1e-7).all()


def test_elastic_net_gives_nothing_to_what_is_never_rated_together():
    rng = np.random.default_rng(1)
    x = (rng.random((60, 40)) < 0.05) * 1.0
    g = x.T @ x
    w = enet_gram(g[1:, 1:], g[1:, 0], 60, 0.01, 0.5)
    assert (w[g[1:, 0] == 0] == 0).all()


@pytest.mark.parametrize("fit", [logistic_newton, svm_squared_hinge])
def test_classifiers_have_no_slope_left(ratings, fit):
    x, sign, c = ratings[:, 1:], np.where(ratings[:, 0] > 0, 1.0, -1.0), 0.5
    w = fit(x, sign, c)

    def loss(v):
        m = sign * (x @ v)
        each = np.logaddexp(0, -m) if fit is logistic_newton else np.maximum(0, 1 - m) ** 2
        return 0.5 * v @ v + c * each.sum()

    for k in range(len(w)):
        e = np.zeros(len(w))
        e[k] = 1e-5
        assert abs(loss(w + e) - loss(w - e)) / 2e-5 < 1e-5


def test_lottery():
    lists = [[1, 2, 3], [3, 4], []]
    out = lottery_merge(lists, [0.5, 0.3, 0.2], 5, draws(2, 7, 5))
    assert sorted(x for x, _ in out) == [1, 2, 3, 4] and all(k in (0, 1) for _, k in out)
    assert lottery_merge([[], []], [0.5, 0.5], 5, draws(0, 1, 0)) == []
    assert [x for x, _ in lottery_merge([[9, 8, 7]], [1.0], 2, draws(0, 1, 3))] == [9, 8]
    assert lottery_merge([[1, 2], [3, 4]], [0.5, 0.5], 3, iter([0.0, 0.999, 0.999]), decay=1.0) == [(1, 0), (3, 1), (4, 1)]
