"""Toy fixtures worked out by hand."""

import pytest
from pyspark.sql import functions as F

from recjobs.operators import classify, evaluate, factors, features, hybrid, linear, prep, ranking, similarity
from recjobs.sources import files

FEATURES = {0: (0, 4), 1: (1, 4), 2: (2, 4), 3: (3, 4), 4: (4, 4), 5: (4, 3), 6: (4, 2), 7: (4, 1), 8: (4, 0)}


@pytest.fixture(scope="module")
def content(spark):
    rows = [(i, "f", str(k), float(v)) for i, pair in FEATURES.items() for k, v in enumerate(pair) if v]
    return spark.createDataFrame(rows, "id long, attr string, token string, weight double").cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, True) for i in FEATURES], "item_id long, active boolean").cache()


def frame(spark, cells):
    return spark.createDataFrame([(u, i, float(r)) for u, row in cells.items() for i, r in row.items()], "user_id long, item_id long, rating double")


BRUTE = {0: {0: 3, 2: 2, 3: 3}, 1: {6: 2, 8: 3}, 2: {4: 1}, 3: {3: 3, 4: 2, 5: 1}}


def lists(recs):
    out = {}
    for r in sorted(recs.collect(), key=lambda r: (r.user_id, r.rank)):
        out.setdefault(r.user_id, []).append((r.item_id, r.score))
    return out


def test_cosine_and_neighbours(content):
    sims = similarity.similarities(similarity.content_dots(content))
    row = {r.j: r.sim for r in sims.filter("i = 0").collect()}
    assert row == {1: 0.970142, 2: 0.894427, 3: 0.8, 4: 0.707106, 5: 0.6, 6: 0.447213, 7: 0.242536}
    near = {}
    for r in similarity.nearest(sims, 2).collect():
        near.setdefault(r.i, set()).add(r.j)
    assert near == {0: {1, 2}, 1: {0, 2}, 2: {1, 3}, 3: {2, 4}, 4: {3, 5}, 5: {4, 6}, 6: {5, 7}, 7: {6, 8}, 8: {6, 7}}
    assert similarity.cut(similarity.nearest(sims, 2), 1).count() == 9


def test_neighbour_scores(spark, content, items):
    ratings = frame(spark, {0: {0: 3, 2: 2, 3: 3}, 1: {6: 2, 8: 3}})
    rounded = similarity.nearest(similarity.similarities(similarity.content_dots(content)), 2).select("i", "j", "rank")
    near = rounded.join(similarity.similarities(similarity.content_dots(content), exact=True), ["i", "j"])
    recs = ranking.top_n(ranking.unseen(ranking.neighbour_scores(ratings, near), ratings), 2)
    assert lists(recs) == {0: [(1, 4.862799), (4, 2.969847)], 1: [(7, 4.862799), (5, 1.967739)]}


def test_brute_force_scores_and_fallback(spark, content, items):
    ratings = frame(spark, BRUTE)
    targets = spark.createDataFrame([(u,) for u in range(5)], "user_id long")
    weights = similarity.as_weights(similarity.similarities(similarity.content_dots(content), exact=True))
    recs = ranking.top_n(ranking.unseen(ranking.item_scores(ratings, weights, items.select("item_id")), ratings), 2)
    assert lists(recs) == {0: [(1, 7.627704), (4, 6.988533)], 1: [(7, 4.862799), (5, 4.367738)], 2: [(3, 0.989949), (5, 0.989949)], 3: [(2, 5.743401), (6, 5.564516)]}
    popular = ranking.popularity(ratings, items)
    full = lists(ranking.with_fallback(recs, targets, popular, items, 2))
    assert full[4] == [(3, 0.0), (4, 0.0)] and len(full) == 5
    seen = ranking.with_fallback(recs, spark.createDataFrame([(9,)], "user_id long"), popular, items, 2, ratings)
    assert lists(seen)[9] == [(3, 0.0), (4, 0.0)]


def test_popularity(spark, items):
    ratings = frame(spark, BRUTE)
    assert [(r.item_id, r.score) for r in ranking.popularity(ratings, items).orderBy("rank").limit(2).collect()] == [(3, 2), (4, 2)]
    assert [(r.item_id, r.score) for r in ranking.popularity(ratings, items, by="sum").orderBy("rank").limit(4).collect()] == [(3, 6), (0, 3), (4, 3), (8, 3)]
    assert ranking.popularity(ratings, items).count() == 9


def test_average_precision(spark):
    recs = spark.createDataFrame([(1, i, k) for k, i in enumerate("abcde", 1)] + [(2, "a", 1)], "user_id long, item_id string, rank int")
    hidden = spark.createDataFrame([(1, "b"), (1, "e"), (3, "z")], "user_id long, item_id string")
    assert {r.user_id: r.ap for r in evaluate.average_precision(recs, hidden).collect()} == {1: 0.45, 3: 0.0}
    assert evaluate.mean_average_precision(recs, hidden.filter("user_id = 1")).first()["map"] == 0.45


def test_hide_and_folds(spark):
    ratings = frame(spark, {u: {i: 1 for i in range(n)} for u, n in enumerate([1, 2, 3, 4, 5, 8])})
    shown = evaluate.hide(ratings, 1).groupBy("user_id").agg(F.count_if("hidden").alias("h")).orderBy("user_id").collect()
    assert [r.h for r in shown] == [0, 1, 1, 1, 2, 2]
    sizes = [r["count"] for r in evaluate.folds(spark.range(10).select(F.col("id").alias("user_id")), 4).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [3, 3, 2, 2]
    assert evaluate.hash_folds(spark.range(200).select(F.col("id").alias("user_id")), 4).select("fold").distinct().count() == 4


def test_shrink_and_blend(spark):
    one = spark.createDataFrame([(1, 2, 1.0, 2)], "i long, j long, dot double, co long")
    assert similarity.similarities(one, 2).first().sim == 0.5 and similarity.similarities(one, 0).first().sim == 1.0
    slim = spark.createDataFrame([(1, 9, 2.0), (2, 9, 1.0)], "src_id long, dst_id long, weight double")
    cb = spark.createDataFrame([(1, 9, 0.5), (3, 9, 0.25)], "src_id long, dst_id long, weight double")
    assert {r.src_id: r.weight for r in hybrid.blend(slim, cb, 0.7).collect()} == {1: 1.0, 2: 0.35, 3: 0.15}


def test_enrich(spark):
    got = hybrid.enrich(frame(spark, {7: {1: 3}}), spark.createDataFrame([(7, 1), (7, 2)], "user_id long, item_id long"))
    assert sorted(map(tuple, got.collect())) == [(7, 1, 1.0), (7, 2, 1.0)]


def test_nulls_in_profiles(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.createDataFrame([(1, "A b", None), (2, None, 4)], "id long, title string, career_level int").write.csv(path, sep="\t", header=True)
    read = files.read_items(spark, path, "id long, title string, career_level int")
    assert {r.id: r.career_level for r in read.collect()} == {1: 0, 2: 4}
    words = {(r.id, r.token) for r in features.tokens(read, "id", ["title"]).collect()}
    assert words == {(1, "a"), (1, "b"), (2, "nan")}
    assert {r.token for r in features.tokens(read, "id", ["title"], "NULL").filter("id = 2").collect()} == {"null"}


def test_learned_weights_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (40, 8)) * (rng.random((40, 8)) < 0.5) * 1.0
    ratings = frame(spark, {u: {i: x[u, i] for i in range(8) if x[u, i]} for u in range(40)})
    gram = linear.gram(ratings)
    got = {(r.src_id, r.dst_id): r.weight for r in linear.slim_ridge(linear.corated(gram), gram, 5.0, positive=False).collect()}
    p = np.linalg.inv(x.T @ x + 5.0 * np.eye(8))
    want = {(i, j): -p[i, j] / p[j, j] for i in range(8) for j in range(8) if i != j}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    signed = np.where(x > 0, 1.0, -1.0)
    found = {(r.src_id, r.dst_id): r.weight for r in linear.scm_ridge(linear.corated(gram), ratings, gram, 5.0).collect()}
    others = [i for i in range(8) if i != 0]
    w = np.linalg.solve((x.T @ x)[np.ix_(others, others)] + 5.0 * np.eye(7), x[:, others].T @ signed[:, 0])
    assert all(abs(found.get((i, 0), 0.0) - max(v, 0.0)) < 1e-9 for i, v in zip(others, w))
    for kind in ("logistic", "svm"):
        assert linear.scm(linear.corated(gram), ratings, kind, 0.1).filter("weight <= 0").isEmpty()


def test_nmf_objective_falls(spark):
    ratings = frame(spark, {u: {i: 1 + (u * i) % 3 for i in range(6) if (u + i) % 2} for u in range(12)}).cache()
    values = []
    for steps in (0, 1, 3):
        p, q = factors.nmf(ratings, 2, steps, l2=0.1)
        values.append(factors.nmf_objective(ratings, p, q, 2, l2=0.1))
    assert values[0] > values[1] > values[2] > 0


def test_dense_index(spark):
    ids = spark.createDataFrame([(k * 7 % 101,) for k in range(101)] * 2, "user_id long")
    assert sorted((r.user_id, r.idx) for r in prep.dense_index(ids, "user_id").collect()) == [(k, k) for k in range(101)]


def test_weak_classes(spark):
    rows = [(0, 0)] * 3 + [(0, 1)] + [(1, 0)] * 4 + [(1, 1)]
    confused = classify.confusion(spark.createDataFrame(rows, "label int, prediction int"), 1)
    assert [(r.label, r.prediction, r.mean_n) for r in classify.weak_classes(confused).collect()] == [(1, 0, 4.0)]


def test_results_do_not_depend_on_partitions(spark, content):
    want = None
    for n in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(map(tuple, similarity.nearest(similarity.similarities(similarity.content_dots(content), 2), 3).collect()))
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
