"""The tree of attributes against plain recursion."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from recjobs.operators import features

CLASSES = [1.0, 2.0, 3.0]


def lost(counts, impurity):
    n = sum(counts)
    if impurity == "gini":
        return n - sum(c * c for c in counts) / max(n, 1)
    return sum(-c * math.log2(c / n) for c in counts if c)


def importance(rows, attrs, impurity, depth):
    """``rows``: (values by attribute, rating)."""
    fall = Counter({a: 0.0 for a in attrs})

    def grow(part, level):
        if level == depth:
            return
        count = lambda some: [sum(r == c for _, r in some) for c in CLASSES]
        found = None
        for k, a in enumerate(attrs):
            ratings = defaultdict(list)
            for values, r in part:
                ratings[values[a]].append(r)
            mean = {v: round(sum(x) / len(x), 6) for v, x in ratings.items()}
            for at in sorted(set(mean.values())):
                left = [x for x in part if mean[x[0][a]] <= at]
                right = [x for x in part if mean[x[0][a]] > at]
                gain = lost(count(part), impurity) - lost(count(left), impurity) - lost(count(right), impurity)
                if gain > 1e-9 and (found is None or (-round(gain, 9), k, at) < found[0]):
                    found = (-round(gain, 9), k, at), a, gain, left, right
        if found:
            fall[found[1]] += found[2]
            grow(found[3], level + 1)
            grow(found[4], level + 1)

    grow(rows, 0)
    total = sum(fall.values())
    return {a: x / total if total else 0.0 for a, x in fall.items()}


@pytest.mark.parametrize("impurity", ["gini", "entropy"])
def test_tree_equals_plain_recursion(spark, impurity):
    rng = np.random.default_rng(8)
    items = [(i, f"word{i}" if i % 2 else None, f"b{rng.integers(4)}", int(rng.integers(6))) for i in range(300)]  # 151 titles
    ratings = [(u, int(i), float(1 + (items[i][3] + (items[i][2] == "b1") + rng.integers(2)) % 3)) for u in range(30) for i in rng.choice(300, 25, replace=False)]
    found = features.attribute_importance(spark.createDataFrame([*ratings, (1, 1, None)], "user_id long, item_id long, rating double"), spark.createDataFrame(items, "item_id long, title string, brand string, size int"), ["title", "brand", "size"], impurity, 3)
    value = {i: {"title": t or "nan", "brand": b, "size": str(s)} for i, t, b, s in items}
    want = importance([(value[i], r) for _, i, r in ratings], ["title", "brand", "size"], impurity, 3)
    got = {r.attr: r.importance for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[a] - want[a]) < 1e-9 for a in want) and got["size"] > 0


def test_values_beyond_any_cap_are_told_apart(spark):
    """600 values of an attribute, half of which stand for one rating."""
    ratings = spark.range(600).selectExpr("id AS user_id", "id AS item_id", "CAST(1 + id % 2 AS DOUBLE) AS rating")
    items = spark.range(600).selectExpr("id AS item_id", "'t' || id AS title", "1 AS brand")
    assert {r.attr: r.importance for r in features.attribute_importance(ratings, items, ["brand", "title"]).collect()} == {"brand": 0.0, "title": 1.0}
    assert features.attribute_importance(ratings.limit(0), items, ["brand"]).count() == 0
    assert features.attribute_importance(ratings.withColumn("rating", ratings.rating * 0), items, ["brand"]).first().importance == 0.0
