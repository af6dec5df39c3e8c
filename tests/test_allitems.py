"""Full-width models against closed forms and single-target solvers."""

import numpy as np
import pytest

from recjobs.functions.kernels import enet_gram, logistic_newton, ridge_gram, svm_squared_hinge
from recjobs.operators import allitems, linear


def table(spark, n_users=70, n_items=25, share=0.25, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 4, (n_users, n_items)) * (rng.random((n_users, n_items)) < share) * 1.0
    rows = [(u, 10 * i + (1 << 40), float(x[u, i])) for u, i in zip(*map(lambda a: a.tolist(), np.nonzero(x)))]
    return x, spark.createDataFrame(rows, "user_id long, item_id long, rating double").repartition(3)


def weights(df):
    return {((r.src_id - (1 << 40)) // 10, (r.dst_id - (1 << 40)) // 10): r.weight for r in df.collect()}


def close(got, want, tolerance=1e-6):
    assert {k for k, v in got.items() if v > 1e-6} == {k for k, v in want.items() if v > 1e-6}
    assert all(abs(v - want.get(k, 0.0)) < tolerance for k, v in got.items())


def one_by_one(x, fit):
    out, n = {}, x.shape[1]
    for t in range(n):
        others = [j for j in range(n) if j != t]
        out |= {(j, t): v for j, v in zip(others, fit(x[:, others], x[:, t])) if v > 0}
    return out


@pytest.fixture(params=["kept", "read again", "sparse"])
def small_parts(request, monkeypatch):
    """Bounds that change how blocks are made, for the solvers in this process."""
    values = {"kept": {"TASK_BYTES": 8 * 25 * 4}, "read again": {"HELD_BYTES": 0}, "sparse": {"DENSE_SHARE": 2.0}}[request.param]
    for k, v in values.items():
        monkeypatch.setattr(allitems, k, v)
    return request.param


def local(ratings, solver):
    """The solver over the same blocks outside of Spark workers, which don't see patched constants."""
    pdf = ratings.toPandas()
    ids = np.sort(pdf["item_id"].unique())
    rows = []
    for _, g in pdf.groupby("user_id"):
        g = g.sort_values("item_id")
        rows.append((np.searchsorted(ids, g["item_id"]), g["rating"].to_numpy()))

    class Blocks(allitems.RowBlocks):
        def _read(self):
            for k in range(0, len(rows), 9):
                part = rows[k : k + 9]
                yield allitems.Rows(np.cumsum([0, *(len(i) for i, _ in part)]), np.concatenate([i for i, _ in part]), np.concatenate([v for _, v in part]), self.n)

    w = solver(Blocks([], len(ids)), np.arange(len(ids)))
    return {(int(i), int(j)): w[i, j] for i, j in zip(*np.nonzero(w > 0))}


def test_row_blocks(spark, small_parts):
    x, ratings = table(spark)
    close(local(ratings, allitems.ridge_solver(5.0)), one_by_one(x, lambda a, y: ridge_gram(a.T @ a, a.T @ y, 5.0)))
    close(local(ratings, allitems.classifier_solver("svm", 0.2)), one_by_one(x, lambda a, y: svm_squared_hinge(a, np.where(y > 0, 1.0, -1.0), 0.2)))


@pytest.mark.parametrize("positive", [True, False])
def test_ridge_equals_the_closed_form(spark, monkeypatch, positive):
    monkeypatch.setattr(allitems, "TASK_BYTES", 8 * 25 * 4)  # 4 targets a block
    x, ratings = table(spark)
    p = np.linalg.inv(x.T @ x + 5.0 * np.eye(25))
    want = {(i, j): -p[i, j] / p[j, j] for i in range(25) for j in range(25) if i != j and (p[i, j] < 0 or not positive)}
    got = weights(allitems.slim_ridge_all(ratings, 5.0, positive=positive))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_ridge_over_corated_items_is_the_same_where_all_are_corated(spark):
    _, ratings = table(spark, share=0.6)
    table_ = linear.gram(ratings)
    close(weights(allitems.slim_ridge_all(ratings, 5.0)), weights(linear.slim_ridge(linear.corated(table_), table_, 5.0)))


def test_elastic_net_and_lasso_equal_coordinate_descent(spark):
    x, ratings = table(spark)
    n = 70
    enet = lambda l1, l2, positive: one_by_one(x, lambda a, y: enet_gram(a.T @ a, a.T @ y, n, l1 + l2, l1 / (l1 + l2), positive, 20_000, 1e-13))
    close(weights(allitems.slim_elastic_net_all(ratings, 0.02, 0.05)), enet(0.02, 0.05, True))
    close(weights(allitems.slim_lasso_all(ratings, 0.03)), enet(0.03, 0.0, False), 1e-5)


def test_users_as_features(spark):
    x, ratings = table(spark, n_users=20)
    want = one_by_one(x.T, lambda a, y: ridge_gram(a.T @ a, a.T @ y, 5.0))
    got = {(r.src_id, r.dst_id): r.weight for r in allitems.user_slim_all(ratings, 5.0).collect()}
    close(got, want)


@pytest.mark.parametrize("kind, fit", [("logistic", logistic_newton), ("svm", svm_squared_hinge), ("ridge", None)])
def test_classifiers_equal_newton(spark, kind, fit):
    x, ratings = table(spark)
    sign = lambda y: np.where(y > 0, 1.0, -1.0)
    want = one_by_one(x, (lambda a, y: fit(a, sign(y), 0.3)) if fit else (lambda a, y: ridge_gram(a.T @ a, a.T @ sign(y), 0.3)))
    got = weights(allitems.scm_all(ratings, kind, 0.3))
    assert len(got) > 20
    close(got, want)


def test_targets_and_empty_tables(spark):
    x, ratings = table(spark)
    some = spark.createDataFrame([((1 << 40) + 30,), ((1 << 40) + 30,), (7,)], "item_id long")  # one twice, one not rated
    got = weights(allitems.slim_ridge_all(ratings, 5.0, some))
    close(got, {k: v for k, v in one_by_one(x, lambda a, y: ridge_gram(a.T @ a, a.T @ y, 5.0)).items() if k[1] == 3})
    empty = ratings.limit(0)
    for found in (allitems.slim_ridge_all(empty, 1.0), allitems.slim_elastic_net_all(empty, 0.1, 0.1), allitems.scm_all(empty, "svm", 1.0), allitems.user_slim_all(empty, 1.0)):
        assert found.collect() == []
    everyone = spark.createDataFrame([(u, i, 1.0) for u in range(4) for i in (0, 1) if i == 0 or u < 2], "user_id long, item_id long, rating double")
    assert {r.dst_id for r in allitems.scm_all(everyone, "logistic", 1.0).collect()} <= {1}
