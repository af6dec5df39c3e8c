"""Numbering and classifiers whose tasks don't grow with the users."""

import re

import numpy as np
import pytest

from recjobs.functions.kernels import logistic_newton, svm_squared_hinge
from recjobs.operators import evaluate, linear, ranking


def ratings_table(spark, n_users=60, n_items=8):
    rng = np.random.default_rng(0)
    x = rng.integers(1, 4, (n_users, n_items)) * (rng.random((n_users, n_items)) < 0.4) * 1.0
    rows = [(u, i, float(x[u, i])) for u, i in zip(*map(lambda a: a.tolist(), np.nonzero(x)))]
    return x, spark.createDataFrame(rows, "user_id long, item_id long, rating double")


@pytest.mark.parametrize("kind, fit", [("logistic", logistic_newton), ("svm", svm_squared_hinge)])
def test_scm_over_parts_of_users_equals_one_fit(spark, monkeypatch, kind, fit):
    monkeypatch.setattr(linear, "USERS_A_PART", 7)
    x, ratings = ratings_table(spark)
    near = spark.createDataFrame([(i, j) for i in range(8) for j in range(8) if i != j], "i long, j long")
    want = {}
    for t in range(8):
        others = [j for j in range(8) if j != t]
        met = x[:, others].any(1)
        w = fit(x[met][:, others], np.where(x[met, t] > 0, 1.0, -1.0), 0.5)
        want |= {(j, t): v for j, v in zip(others, w) if v > 0}
    got = {(r.src_id, r.dst_id): r.weight for r in linear.scm(near, ratings, kind, 0.5).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def all_in_one_window(df):
    windows = re.findall(r"windowspecdefinition\(([^#]*)#", df._jdf.queryExecution().analyzed().toString())
    return any(first != "part" for first in windows)  # dense_index's are over parts


@pytest.mark.parametrize("seed", [None, 5])
@pytest.mark.parametrize("n, k", [(11, 4), (3, 5), (0, 2)])
def test_folds_are_ntiles_without_one_window(spark, seed, n, k):
    users = spark.range(n).withColumnRenamed("id", "user_id")
    got = evaluate.folds(users, k, seed)
    assert not all_in_one_window(got)
    sizes = [0] * k
    for r in got.collect():
        sizes[r.fold] += 1
        assert seed is not None or r.fold == next(f for f in range(k) if r.user_id < sum(n // k + (g < n % k) for g in range(f + 1)))
    assert sizes == [n // k + (f < n % k) for f in range(k)]


def test_popularity_without_one_window(spark):
    x, ratings = ratings_table(spark)
    got = ranking.popularity(ratings, spark.range(10).withColumnRenamed("id", "item_id"))
    assert not all_in_one_window(got)
    count = [*(x > 0).sum(0).tolist(), 0, 0]
    assert [(r.item_id, r.score) for r in sorted(got.collect(), key=lambda r: r.rank)] == [(i, count[i]) for i in sorted(range(10), key=lambda i: (-count[i], i))]
