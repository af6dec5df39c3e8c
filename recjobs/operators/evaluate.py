"""Sampling, folds, hidden ratings and MAP@n."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, Window, functions as F

from recjobs.functions.columns import md5_order, rounded
from recjobs.functions.storage import materialize
from recjobs.operators import pairs
from recjobs.operators.prep import dense_index

Recommender = Callable[[DataFrame, DataFrame, dict], DataFrame]  # (ratings, targets, params) -> recs


def sample_users(ratings: DataFrame, m: int, seed: int, user_bias: DataFrame | None = None):
    """All ratings of m users, chosen by a seeded hash (of all, if there are fewer); with
    ``user_bias(user_id, ...)`` also the rows of these users there."""
    users = ratings.select("user_id").distinct().orderBy(md5_order(seed, "user_id"), "user_id").limit(m)
    sample = ratings.join(users, "user_id", "left_semi")
    return sample if user_bias is None else (sample, user_bias.join(users, "user_id", "left_semi"))


def sample_interactions(ratings: DataFrame, m: int, seed: int) -> DataFrame:
    """m ratings, chosen by a seeded hash; users and items without one are gone with the rest."""
    return ratings.orderBy(md5_order(seed, "user_id", "item_id"), "user_id", "item_id").limit(m)


def of_sample(sample: DataFrame, items: DataFrame, item_content: DataFrame, user_content: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """Items (with their activity) and content ``(id, ...)`` of what a sample of ratings still holds."""
    held = sample.select(F.col("item_id").alias("id")).distinct()
    out = [items.join(held.withColumnRenamed("id", "item_id"), "item_id", "left_semi"), item_content.join(held, "id", "left_semi")]
    if user_content is not None:
        out.append(user_content.join(sample.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi"))
    return tuple(out)


def sample_share(ratings: DataFrame, share: float, seed: int) -> DataFrame:
    """About this share of the ratings, by a seeded hash of each: no order of the whole table."""
    key = F.conv(F.substring(md5_order(seed, "user_id", "item_id"), 1, 8), 16, 10).cast("long")
    return ratings.filter(key < int(share * (1 << 32)))


def holdout(ratings: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Visible and hidden ratings of a sample: users that it leaves empty are gone, and of the others
    some ratings are hidden (``hide``). A recommender is fitted on the visible ones and scores them."""
    shown = materialize(hide(sample_share(ratings, share, seed), seed), "shown")
    return shown.filter("not hidden").drop("hidden"), shown.filter("hidden").drop("hidden")


def repeated_splits(ratings: DataFrame, recommend: Recommender, params: dict, seed: int, repetitions: int, share: float = 0.75, n: int = 5) -> DataFrame:
    """``(rep, map, n_users)``: in each random split of interactions users with test items are scored on
    their train profile; one without a train profile has no list, and counts as 0."""
    out, split = None, materialize(split_interactions(ratings, seed, repetitions, share), "splits")
    for rep in range(repetitions):
        own = split.filter(F.col("rep") == rep)
        train, test = (own.filter(x).select("user_id", "item_id", "rating") for x in ("not test", "test"))
        profiles = train.join(test.select("user_id").distinct(), "user_id", "left_semi")
        one = mean_average_precision(recommend(train, profiles, params), test, n).select(F.lit(rep).alias("rep"), "map", "n_users")
        out = one if out is None else out.unionByName(one)
    return out


def folds(users: DataFrame, k: int, seed: int | None = None) -> DataFrame:
    """``(user_id, fold)``, from 0: contiguous groups that differ by one at most; shuffled if seeded.
    Users are numbered by ranges, so no task holds them all."""
    order = [F.col("user_id")] if seed is None else [md5_order(seed, "user_id").alias("place"), F.col("user_id")]
    numbered = dense_index(users.select(F.struct(*order).alias("key")), "key")
    size, larger = divmod(numbered.count(), k)  # as ntile: the first ``larger`` groups have one more
    idx, ahead = F.col("idx"), larger * (size + 1)
    fold = F.when(idx < ahead, F.floor(idx / (size + 1))).otherwise(larger + F.floor((idx - ahead) / max(size, 1)))
    return numbered.select("key.user_id", fold.cast("int").alias("fold"))


def hash_folds(users: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """``(user_id, fold)`` by a seeded hash: sizes are near equal, and nothing is ordered."""
    fold = F.pmod(F.conv(F.substring(md5_order(seed, "user_id"), 1, 8), 16, 10).cast("long"), F.lit(k))
    return users.select("user_id").distinct().select("user_id", fold.cast("int").alias("fold"))


def hide(ratings: DataFrame, seed: int, share: float = 0.75, more_than: int = 1) -> DataFrame:
    """Ratings with ``hidden``: users of more than so many items keep floor(share * count) of them."""
    order = Window.partitionBy("user_id").orderBy(md5_order(seed, "user_id", "item_id"), "item_id")
    count = F.count("*").over(Window.partitionBy("user_id"))
    hidden = (count > more_than) & (F.row_number().over(order) > F.floor(F.lit(share) * count))
    return ratings.withColumn("hidden", hidden)


def split_interactions(ratings: DataFrame, seed: int, repetitions: int, share: float = 0.75) -> DataFrame:
    """Repeated random splits: ``rep`` and ``test``. The cut is at the share of md5 prefixes, so no
    table is ordered as a whole."""
    reps = ratings.withColumn("rep", F.explode(F.array(*(F.lit(r) for r in range(repetitions)))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("user_id").cast("string"), F.col("item_id").cast("string")))
    place = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return reps.withColumn("test", place >= int(share * (1 << 32)))


def average_precision(recs: DataFrame, hidden: DataFrame, n: int = 5, settings: list[str] = []) -> DataFrame:  # noqa: B006
    """``(user_id, ap)`` of users with hidden items: sum of precision at hits over min(hidden, listed).
    ``settings`` are columns of both tables that tell lists of several recommenders apart."""
    own = [*settings, "user_id"]
    listed = recs.filter(F.col("rank") <= n)
    rel = listed.join(hidden.select(*own, "item_id", F.lit(1).alias("rel")), [*own, "item_id"], "left").fillna(0, ["rel"])
    running = Window.partitionBy(*own).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = rel.withColumn("p", F.col("rel") * F.sum("rel").over(running) / F.col("rank"))
    sums = at.groupBy(*own).agg(F.sum("p").alias("s"), F.count("*").alias("n_rec"))
    counts = hidden.groupBy(*own).agg(F.count("*").alias("n_hidden"))
    return counts.join(sums, own, "left").select(*own, rounded(F.coalesce(F.col("s") / F.least("n_hidden", "n_rec"), F.lit(0.0))).alias("ap"))


def mean_average_precision(recs: DataFrame, hidden: DataFrame, n: int = 5) -> DataFrame:
    """``(map, n_users)``: the mean over users with hidden items; 0 of 0 users without any."""
    return average_precision(recs, hidden, n).agg(rounded(F.coalesce(F.avg("ap"), F.lit(0.0))).alias("map"), F.count("*").alias("n_users"))


def grid(params: dict[str, list]) -> list[dict]:
    """All settings, the last parameter changing first."""
    return [dict(zip(params, values)) for values in product(*params.values())]


def cross_validate(ratings: DataFrame, recommend: Recommender, params: dict[str, list], k: int, seed: int, n: int = 5, profiles: DataFrame | None = None, fit_on: str = "train", max_folds: int | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(params..., fold, map)``. Each fold's users are scored on what is visible of them.

    ``fit_on`` 'train' fits on the other users, 'visible' on those and what is visible of the fold;
    ``profiles`` is another table of the same users to score and hide (an explicit one, say).
    ``prepare(ratings)`` makes, once a fold, the table that all settings share (dots, a Gram table);
    ``recommend`` then gets it in place of the ratings. Without ratings there are no rows.
    """
    shown = hide(profiles if profiles is not None else ratings, seed)
    fold_of = materialize(folds(ratings, k, seed), "folds")
    spark, out = ratings.sparkSession, []
    for fold in range(min(k, max_folds or k)):
        test = fold_of.filter(F.col("fold") == fold)
        of_fold = materialize(shown.join(test, "user_id", "left_semi"), "shown")
        visible, hidden = of_fold.filter("not hidden").drop("hidden"), of_fold.filter("hidden").drop("hidden")
        base = ratings.join(test, "user_id", "left_anti")
        if fit_on != "train":
            base = base.unionByName(visible)
        if prepare is not None:
            base = materialize(prepare(base), "prepared")
        for p in grid(params):
            found = mean_average_precision(recommend(base, visible, p), hidden, n).first()
            out.append((*p.values(), fold, found["map"]))
    names = ", ".join(f"{c} {'double' if isinstance(v[0], float) else 'string' if isinstance(v[0], str) else 'long'}" for c, v in params.items())
    return spark.createDataFrame(out, f"{names}, fold int, map double")


def neighbour_grid(ratings: DataFrame, active: DataFrame, shrinks: list[int], ks: list[int], k: int, seed: int, n: int = 5, profiles: DataFrame | None = None) -> DataFrame:
    """``(fold, shrink, k, map)``: item neighbours cross-validated over k folds and all settings, in one
    plan. As ``cross_validate`` gives it, but that a fold without hidden ratings has no row.

    Pairs of items are summed up once, by fold, in tasks (``pairs``): what a fold's training set has is the
    whole less its own (exact for ratings of whole numbers). A smaller k is cut from the largest by rank."""
    fold_of = materialize(folds(ratings, k, seed), "folds")
    own = materialize(ratings.join(fold_of, "user_id"), "own")
    near = pairs.nearest_without(own, "fold", k, max(ks), shrinks)
    weights = near.select(F.col("i").alias("src_id"), F.col("j").alias("dst_id"), F.col("sim").alias("weight"), "part", "variant", "rank")
    catalogue = own.select("item_id").distinct().join(active.select("item_id", F.lit(True).alias("active")), "item_id", "left")

    shown = materialize(hide(profiles if profiles is not None else ratings, seed).join(fold_of, "user_id"), "shown")
    visible, hidden = shown.filter("not hidden"), shown.filter("hidden")
    asked = [(shrink, c) for shrink in shrinks for c in ks]
    lists = pairs.scores(visible.withColumnRenamed("fold", "part"), weights, catalogue, unseen=True, n=n, parts=k, variants=[(shrinks.index(shrink), c) for shrink, c in asked])
    told = F.array(*(F.struct(F.lit(shrink).cast("long").alias("shrink"), F.lit(c).cast("long").alias("k")) for shrink, c in asked))
    lists = lists.withColumn("x", F.get(told, F.col("setting"))).select(F.col("part").alias("fold"), "x.*", "user_id", "item_id", "score", "rank")
    settings = ["fold", "shrink", "k"]
    found = average_precision(lists, hidden.select("fold", "user_id", "item_id", F.explode(told).alias("x")).select("fold", "user_id", "item_id", "x.*"), n, settings)
    return found.groupBy(*settings).agg(rounded(F.avg("ap")).alias("map"))


def summarise(scores: DataFrame, params: list[str]) -> DataFrame:
    """Mean and population deviation of ``map`` of each setting, over folds."""
    return scores.groupBy(*params).agg(rounded(F.avg("map")).alias("mean_map"), rounded(F.stddev_pop("map")).alias("std_map"))


def best_setting(summary: DataFrame, params: list[str]) -> DataFrame:
    """The setting of largest mean (ties: the first in parameter order)."""
    top = summary.agg(F.min_by(F.struct(*params, "mean_map"), F.struct(-F.col("mean_map"), *params)).alias("x"))
    return top.select("x.*")


def best_per_facet(summary: DataFrame, facet: str, params: list[str]) -> DataFrame:
    """The setting of largest mean for each value of ``facet``, ties to the first in parameter order."""
    rest = [p for p in params if p != facet]
    top = summary.groupBy(facet).agg(F.min_by(F.struct(*rest, "mean_map"), F.struct(-F.col("mean_map"), *rest)).alias("x"))
    return top.select(facet, "x.*")
