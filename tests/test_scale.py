"""Blocks, cuts and expansions give what the plain definitions give."""

import numpy as np
import pytest

from recjobs.functions.kernels import enet_gram
from recjobs.jobs import recommend
from recjobs.operators import classify, evaluate, factors, hybrid, linear, prep, ranking, similarity

RATING = "user_id long, item_id long, rating double"


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(4)
    x = rng.integers(1, 4, (30, 14)) * (rng.random((30, 14)) < 0.4) * 1.0
    x[3] = rng.integers(1, 4, 14)  # one user rated everything
    return x


@pytest.fixture(scope="module")
def ratings(spark, matrix):
    return spark.createDataFrame([(u, i, float(matrix[u, i])) for u, i in zip(*map(lambda a: a.tolist(), np.nonzero(matrix)))], RATING).cache()


def test_profiles_meet_by_blocks(ratings, matrix, monkeypatch):
    monkeypatch.setattr(similarity, "PROFILE_BLOCK", 3)
    g = matrix.T @ matrix
    assert {(r.i, r.j): r.g for r in linear.gram(ratings).collect()} == {(i, j): g[i, j] for i in range(14) for j in range(14) if g[i, j]}
    norm = np.sqrt((matrix**2).sum(0)) + 1e-6
    dots = {(r.i, r.j): (r.dot, r.co) for r in similarity.rating_dots(ratings).collect()}
    both = (matrix > 0).T.astype(int) @ (matrix > 0)
    assert dots.keys() == {(i, j) for i in range(14) for j in range(14) if i != j and both[i, j]}
    assert all(abs(d - g[k] / norm[k[0]] / norm[k[1]]) < 1e-9 and co == both[k] for k, (d, co) in dots.items())


def test_kinds_are_expanded(spark):
    """Rows of equal content: all pairs, and the k nearest with ties to the smaller id."""
    rng = np.random.default_rng(1)
    rows = [(i, "a", f"t{t}", 1.0) for i in range(40) for t in {int(rng.integers(4)), int(rng.integers(4))}]
    content = spark.createDataFrame(rows, "id long, attr string, token string, weight double").cache()
    vectors = np.zeros((40, 4))
    for i, _, t, _ in rows:
        vectors[i, int(t[1])] = 1
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-6)
    sims = np.floor(unit @ unit.T * 1e6 + 0.5) / 1e6
    every = similarity.similarities(similarity.content_dots(content))
    assert {(r.i, r.j) for r in every.collect()} == {(i, j) for i in range(40) for j in range(40) if i != j and sims[i, j] > 0}
    for left, right in ((None, None), (range(0, 40, 3), range(5, 40))):
        sides = [None if x is None else spark.createDataFrame([(i,) for i in x], "id long") for x in (left, right)]
        got = {}
        for r in similarity.content_nearest(content, 5, 0, *sides).collect():
            got.setdefault(r.i, {})[r.rank] = r.j
        for i in left or range(40):
            order = sorted((j for j in right or range(40) if j != i and sims[i, j] > 0), key=lambda j: (-round(sims[i, j], 6), j))
            assert [got[i][k] for k in sorted(got[i])] == order[:5]


def test_popular_items_by_blocks(spark, ratings, matrix, monkeypatch):
    monkeypatch.setattr(ranking, "HEAD", 4)
    items = spark.createDataFrame([(i, i % 5 > 0) for i in range(20)], "item_id long, active boolean")
    targets = spark.createDataFrame([(u,) for u in [*range(12), 99]], "user_id long")
    popular = ranking.popularity(ratings, items)
    order = [r.item_id for r in popular.orderBy("rank").collect() if r.item_id % 5]
    got = {}
    for r in ranking.popular_unseen(popular, items, ratings, targets, 5).collect():
        got.setdefault(r.user_id, {})[r.rank] = r.item_id
    for u in [*range(12), 99]:
        mine = set(np.flatnonzero(matrix[u]).tolist()) if u < 30 else set()
        want = [i for i in order if i not in mine][:5]
        assert [got.get(u, {})[k + 1] for k in range(len(want))] == want and len(got.get(u, {})) == len(want)


def test_factor_scores_by_blocks(spark, ratings, matrix, monkeypatch):
    monkeypatch.setattr(factors, "BLOCK_ITEMS", 3)
    rng = np.random.default_rng(2)
    p, q = rng.random((30, 2)), rng.random((14, 2))
    users = spark.createDataFrame([(u, p[u].tolist()) for u in range(30)], "user_id long, features array<double>")
    items = spark.createDataFrame([(i, q[i].tolist()) for i in range(14)], "item_id long, features array<double>")
    active = spark.createDataFrame([(i,) for i in range(14) if i != 2], "item_id long")
    targets = spark.createDataFrame([(u,) for u in range(8)], "user_id long")
    got = {}
    for r in factors.factor_scores(users, items, targets, ratings, active, 3).collect():
        got.setdefault(r.user_id, {})[r.rank] = r.item_id
    for u in range(8):
        free = [i for i in range(14) if i != 2 and not matrix[u, i]]
        want = sorted(free, key=lambda i: (-(p[u] @ q[i]), i))[:3]
        assert [got.get(u, {})[k] for k in sorted(got.get(u, {}))] == want


def test_singular_values(ratings, matrix):
    rows = factors.singular_values(ratings, 4, steps=40).orderBy("component").collect()
    want = np.linalg.svd(matrix, compute_uv=False)[:4]
    assert np.allclose([r.value for r in rows], want, rtol=1e-3)
    assert np.allclose([r.explained for r in rows], np.cumsum(want**2) / (matrix**2).sum(), rtol=1e-3)


def test_learned_weights_of_bounded_features(spark, ratings, matrix):
    gram = linear.gram(ratings).cache()
    g = matrix.T @ matrix
    near = {t: sorted((i for i in range(14) if i != t and g[t, i] > 0), key=lambda i: (-g[t, i], i))[:5] for t in range(14)}
    found = linear.strongest(gram, 5)
    assert {(r.i, r.j) for r in found.collect()} == {(t, i) for t, x in near.items() for i in x}
    fits = {
        "ridge": (linear.slim_ridge(found, gram, 5.0), lambda a, b: np.linalg.solve(a + 5.0 * np.eye(len(a)), b)),
        "net": (linear.slim_elastic_net(found, gram, 30, 0.01, 0.05), lambda a, b: enet_gram(a, b, 30, 0.06, 0.01 / 0.06)),
        "lasso": (linear.slim_lasso(found, gram, 30, 0.05), lambda a, b: enet_gram(a, b, 30, 0.05, 1.0, False)),
    }
    for table, solve in fits.values():
        want = {(i, t): w for t, x in near.items() for i, w in zip(x, solve(g[np.ix_(x, x)], g[x, t])) if w > 0}
        got = {(r.src_id, r.dst_id): r.weight for r in table.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    h = matrix @ matrix.T
    close = {t: sorted((i for i in range(30) if i != t and h[t, i] > 0), key=lambda i: (-h[t, i], i))[:4] for t in range(30)}
    want = {(i, t): w for t, x in close.items() for i, w in zip(x, np.linalg.solve(h[np.ix_(x, x)] + 9.0 * np.eye(len(x)), h[x, t])) if w > 0}
    got = {(r.src_id, r.dst_id): r.weight for r in linear.user_slim(ratings, 9.0, 4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    first = linear.slim_ridge(found, gram, 5.0)
    again = linear.refit(first, gram, 5.0, 2, 1)
    assert {(r.src_id, r.dst_id) for r in again.collect()} <= {(r.src_id, r.dst_id) for r in first.collect()}


def test_self_training_fits_on_implicit_ratings(spark, ratings):
    met = []

    def fit(table):
        met.append(sorted((r.user_id, r.item_id, r.rating) for r in table.collect()))
        return spark.createDataFrame([(1, 2, 1.0)], "src_id long, dst_id long, weight double")

    added = spark.createDataFrame([(99, 1, 1, 1.0)], "user_id long, item_id long, rank int, score double")
    hybrid.self_training(ratings, fit, lambda explicit, weights, n: added, [2, 1])
    plain = sorted((r.user_id, r.item_id, 1.0) for r in ratings.collect())
    assert met == [plain, sorted([*plain, (99, 1, 1.0)]), sorted([*plain, (99, 1, 1.0)])]


def test_samples_and_holdouts(spark, ratings):
    items = spark.createDataFrame([(i, True) for i in range(14)], "item_id long, active boolean")
    content = spark.createDataFrame([(i, "a", f"t{i}", 1.0) for i in range(14)], "id long, attr string, token string, weight double")
    sample = evaluate.sample_interactions(ratings, 3, 1).cache()
    kept, words = evaluate.of_sample(sample, items, content)
    held = {r.item_id for r in sample.collect()}
    assert {r.item_id for r in kept.collect()} == held == {r.id for r in words.collect()}
    visible, hidden = evaluate.holdout(ratings, 0.5, 3)
    v, h = ({(r.user_id, r.item_id) for r in x.collect()} for x in (visible, hidden))
    assert not v & h and v | h == {(r.user_id, r.item_id) for r in evaluate.sample_share(ratings, 0.5, 3).collect()}
    assert {u for u, _ in h} <= {u for u, _ in v}
    biases = prep.global_effects(ratings).select("user_id", "user_bias").distinct()
    some, theirs = evaluate.sample_users(ratings, 4, 2, biases)
    assert {r.user_id for r in some.collect()} == {r.user_id for r in theirs.collect()} and theirs.count() == 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], RATING)
    items = spark.createDataFrame([], "item_id long, active boolean")
    targets = spark.createDataFrame([], "user_id long")
    gram = linear.gram(none)
    near = linear.strongest(gram, 3)
    empty = [
        gram, similarity.rating_dots(none), similarity.content_nearest(none.selectExpr("item_id AS id", "'a' AS attr", "'t' AS token", "rating AS weight"), 3),
        linear.slim_ridge(near, gram, 1.0), linear.scm(near, none, "svm", 1.0), linear.scm_ridge(near, none, gram, 1.0), linear.user_slim(none, 1.0, 3),
        ranking.popularity(none, items), ranking.popular_unseen(ranking.popularity(none, items), items, none, targets, 5), recommend.collaborative_top_n(none, items, targets),
        prep.global_effects(none), prep.dense_index(none, "user_id"), evaluate.hide(none, 1), evaluate.folds(none, 3), factors.singular_values(none, 3), hybrid.enrich(none, none), prep.max_per_pair(none.withColumnRenamed("rating", "interaction_type")),
    ]
    assert [df.count() for df in empty] == [0] * len(empty)
    assert evaluate.mean_average_precision(none.selectExpr("user_id", "item_id", "1 AS rank"), none).first() == (0.0, 0)


def test_search_of_large_products_stops_early(spark, monkeypatch):
    """Exact lists, though most users meet few of the blocks."""
    monkeypatch.setattr(factors, "BLOCK_ITEMS", 10)
    rng = np.random.default_rng(6)
    p, q = rng.normal(size=(40, 3)), rng.normal(size=(120, 3)) * np.exp(rng.normal(size=(120, 1)))
    q[5] = q[6]  # a tie
    q[7] = 0.0
    big = 1 << 40
    users = spark.createDataFrame([(u, p[u].tolist()) for u in range(40)], "user_id long, features array<double>")
    items = spark.createDataFrame([(big + i, q[i].tolist()) for i in range(120)], "item_id long, features array<double>")
    active = spark.createDataFrame([(big + i,) for i in range(120) if i % 9], "item_id long")
    seen = spark.createDataFrame([(u, big + i, 1.0) for u in range(40) for i in range(120) if (u + i) % 4 == 0], RATING)
    targets = spark.createDataFrame([(u,) for u in [*range(35), 77, 3]], "user_id long")
    met = []
    got = {}
    for r in factors.factor_scores(users, items, targets, seen, active, 4, met).collect():
        got.setdefault(r.user_id, {})[r.rank] = (r.item_id - big, r.score)
    for u in range(35):
        free = [i for i in range(120) if i % 9 and (u + i) % 4 and p[u] @ q[i] > 0]
        score = lambda i: np.floor(p[u] @ q[i] * 1e6 + 0.5) / 1e6  # noqa: E731, B023
        want = sorted(free, key=lambda i: (-score(i), i))[:4]
        assert [got.get(u, {})[k][0] for k in sorted(got.get(u, {}))] == want
    assert met[0] == (0, 35) and sum(n for _, n in met) < 35 * 11 * 0.8
    none = spark.createDataFrame([], "item_id long")
    assert factors.factor_scores(users, items, targets, seen, none, 4).count() == 0


def test_classifiers_of_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, None if k % 7 == 0 else f"word{k % 2} more", k % 2) for k in range(40)] + [(99, "word1", None)], "id long, text string, label int")
    model = classify.text_classifier(docs, 0.01, 0.0)
    found = {r.id: r for r in classify.class_probabilities(model, docs).collect()}
    assert len(found) == 41 and found[1].prediction == 1 and found[2].prediction == 0 and abs(sum(found[7].probability) - 1) < 1e-9
    assert classify.text_classifier(docs.limit(0), 0.01, 0.0) is None
    assert classify.class_probabilities(None, docs).count() == classify.tune_classifier(docs.limit(0), [0.1], [0.0]).count() == 0
    assert classify.tune_classifier(docs, [0.1], [0.0]).count() == 1


def test_padded_lists(spark, ratings, matrix):
    items = spark.createDataFrame([(i, i % 5 > 0) for i in range(14)], "item_id long, active boolean")
    recs = spark.createDataFrame([(0, 3, 2.0, 1), (0, 8, 1.0, 2), (1, 9, 1.0, 1)] + [(2, i, 9.0 - i, i) for i in range(1, 5)], "user_id long, item_id long, score double, rank int")
    targets = spark.createDataFrame([(0,), (1,), (2,), (3,), (77,), (77,)], "user_id long")
    popular = ranking.popularity(ratings, items)
    order = [r.item_id for r in popular.orderBy("rank").collect() if r.item_id % 5]
    got = {}
    for r in ranking.padded(recs, targets, popular, items, ratings, 4).collect():
        got.setdefault(r.user_id, {})[r.rank] = (r.item_id, r.score)
    own = {0: [3, 8], 1: [9], 2: [1, 2, 3, 4], 3: [], 77: []}
    for u, listed in own.items():
        seen = set(np.flatnonzero(matrix[u]).tolist()) if u < 30 else set()
        more = [i for i in order if i not in seen and i not in listed][: 4 - len(listed)]
        assert [got.get(u, {})[k][0] for k in sorted(got.get(u, {}))] == listed + more and all(got[u][k + 1][1] == 0.0 for k in range(len(listed), len(listed + more)))


def test_predictions_of_repeated_splits(spark):
    docs = spark.createDataFrame([(k, None if k % 11 == 0 else f"word{k % 3} more", k % 3) for k in range(60)], "id long, text string, label int")
    found = classify.repeated_predictions(docs, 2, 0.001)
    rows = found.collect()
    assert len(rows) == 30 and {r.rep for r in rows} == {0, 1} and all(0 <= r.probability <= 1 for r in rows)
    assert sum(r.prediction == r.label for r in rows) > 20
    assert classify.repeated_predictions(docs.limit(0), 2, 0.001).count() == 0
    split = {(r.rep, r.id) for r in classify.stratified_split(docs.select("id", "label"), 2, 0.25, 1).filter("test").collect()}
    assert {(r.rep, r.id) for r in rows} == split


@pytest.mark.parametrize(("words", "vocabulary", "k", "shrink"), [(5, 9, 4, 2), (40, 60, 3, 2), (2, 3, 50, 1)])
def test_nearest_content_against_all_pairs(spark, monkeypatch, words, vocabulary, k, shrink):
    """Short rows meet under several tokens, long ones under rare tokens first; a token of most rows,
    rows of one token, ties, two sides, more neighbours asked for than there are."""
    monkeypatch.setattr(similarity, "KEY_BLOCK", 16)
    monkeypatch.setattr(similarity, "RARE", 1)
    monkeypatch.setattr(similarity, "FIRST_PAIRS", 1)
    rng = np.random.default_rng(words)
    rows = [(0, "a", "all", 1.0), (1, "b", "alone", 2.0)]
    for i in range(2, 90):
        drawn = {int(vocabulary * rng.random() ** 2) for _ in range(words)}
        rows += [(i, "ab"[w % 2], f"t{w}", float(1 + w % 4)) for w in drawn] + [(i, "a", "all", 0.5)] * (i % 3 > 0)
    content = spark.createDataFrame(rows, "id long, attr string, token string, weight double").cache()
    for left, right in ((None, None), (range(0, 90, 3), range(10, 90))):
        sides = [None if x is None else spark.createDataFrame([(i,) for i in x], "id long") for x in (left, right)]
        every = similarity.similarities(similarity.content_dots(content, *sides), shrink)
        want = {(r.i, r.j, r.rank): r.sim for r in similarity.nearest(every, k).collect()}
        got = {(r.i, r.j, r.rank): r.sim for r in similarity.content_nearest(content, k, shrink, *sides).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
