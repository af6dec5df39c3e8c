"""Grids in one plan, and tables kept up by what is added."""

import numpy as np
import pytest

from recjobs.operators import evaluate, linear, prep, ranking, similarity

RATING = "user_id long, item_id long, rating double"


def table(spark, n_users=40, n_items=18, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 4, (n_users, n_items)) * (rng.random((n_users, n_items)) < 0.35) * 1.0
    return spark.createDataFrame([(u, i, float(x[u, i])) for u, i in zip(*map(lambda a: a.tolist(), np.nonzero(x)))], RATING).cache()


@pytest.mark.parametrize("implicit", [False, True])
def test_grid_in_one_plan_equals_fold_by_fold(spark, implicit):
    ratings = table(spark)
    active = spark.createDataFrame([(i,) for i in range(18) if i % 5], "item_id long")
    fitted = prep.implicit(ratings) if implicit else ratings

    def recommend(dots, profiles, p):
        weights = similarity.as_weights(similarity.nearest(similarity.similarities(dots, p["shrink"]), p["k"]))
        return ranking.top_n(ranking.unseen(ranking.item_scores(profiles, weights, active), profiles), 5)

    want = evaluate.cross_validate(fitted, recommend, {"shrink": [0, 3], "k": [2, 6]}, 3, 7, profiles=ratings, prepare=similarity.rating_dots)
    got = evaluate.neighbour_grid(fitted, active, [0, 3], [2, 6], 3, 7, profiles=ratings)
    rows = lambda df: sorted((r.fold, r.shrink, r.k, r.map) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 12 and any(r[3] > 0 for r in rows(got))
    assert evaluate.neighbour_grid(ratings.limit(0), active, [0], [2], 2, 1).count() == 0


def test_jobs_do_not_grow_with_the_grid(spark):
    ratings, active = table(spark), spark.createDataFrame([(i,) for i in range(18)], "item_id long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        jobs = []
        for shrinks, ks in (([1], [2]), ([0, 1, 2, 3], [2, 3, 4])):
            spark.sparkContext.setJobGroup(f"grid {ks}", "counted")
            assert evaluate.neighbour_grid(ratings, active, shrinks, ks, 3, 7).count() == 3 * len(shrinks) * len(ks)
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"grid {ks}")))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_gram_table_kept_up(spark):
    ratings = table(spark)
    old = ratings.filter("(user_id * 7 + item_id * 3) % 5 > 0")
    new = ratings.filter("(user_id * 7 + item_id * 3) % 5 = 0")
    rows = lambda df: {(r.i, r.j): r.g for r in df.collect()}
    assert rows(linear.gram_added(linear.gram(old), old, new)) == rows(linear.gram(ratings))
    assert rows(linear.gram_added(linear.gram(old), old, new.limit(0))) == rows(linear.gram(old))
