"""Whole recommendation jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from recjobs.functions.storage import materialize
from recjobs.operators import features, hybrid, linear, pairs, ranking, similarity


def collaborative_top_n(ratings: DataFrame, items: DataFrame, targets: DataFrame, k: int = 50, shrink: int = 10, n: int = 5) -> DataFrame:
    """Item neighbours by common raters; n unseen active items a target, popular ones for the rest."""
    weights = similarity.as_weights(pairs.nearest(ratings, k, shrink))
    lists = pairs.scores(ratings.join(targets, "user_id", "left_semi"), weights, items, unseen=True, n=n)
    return ranking.with_fallback(materialize(lists, "lists"), targets, ranking.popularity(ratings, items), items, n)


def recommend_with(ratings: DataFrame, weights: DataFrame, items: DataFrame, targets: DataFrame, n: int = 5) -> DataFrame:
    """n unseen active items a target by these weights, each once; targets without one (of an empty profile,
    say) get the most popular active items. Without targets there are no rows."""
    mine = ratings.join(targets, "user_id", "left_semi")
    scores = ranking.item_scores(mine, weights, items.filter("active").select("item_id"))
    lists = ranking.top_n(ranking.unseen(scores, mine), n)
    return ranking.with_fallback(lists, targets, ranking.popularity(ratings, items), items, n)


def content_weights(content: DataFrame, shrink: int, k: int, left: DataFrame | None = None) -> DataFrame:
    """Votes between the k nearest rows by content, as weights."""
    return similarity.as_weights(similarity.content_nearest(content, k, shrink, left))


def content_top_n(ratings: DataFrame, items: DataFrame, targets: DataFrame, content: DataFrame, shrink: int = 2, n: int = 5, normalize: bool = False) -> DataFrame:
    """Brute force over the items rated by targets, with no cut of neighbours."""
    mine = ratings.join(targets, "user_id", "left_semi")
    rated = mine.select(mine.item_id.alias("id")).distinct()
    sims = similarity.similarities(similarity.content_dots(content, rated), shrink)
    weights = similarity.as_weights(sims)
    scores = ranking.item_scores(mine, weights, items.filter("active").select("item_id"), normalize)
    lists = ranking.top_n(ranking.unseen(scores, mine), n)
    return ranking.with_fallback(lists, targets, ranking.popularity(ratings, items), items, n)


def user_content(users: DataFrame, n_rows: int) -> DataFrame:
    """One-hot segment and TF-IDF location of users ``(user_id, segment, nation, region)``; nulls are words, too."""
    placed = features.location(users, "nation", "region")
    return features.content_table(placed, "user_id", ["segment"], ["location"], n_rows)


def user_neighbours(users: DataFrame, cold: DataFrame, ratings: DataFrame, n_rows: int, k: int, shrink: int = 0) -> DataFrame:
    """Nearest users with a profile, for cold ones. Users of equal attributes are compared once."""
    ids = [x.select(F.col("user_id").alias("id")).distinct() for x in (cold, ratings)]
    return similarity.content_nearest(user_content(users, n_rows), k, shrink, *ids)


def cold_top_n(ratings: DataFrame, users: DataFrame, items: DataFrame, targets: DataFrame, weights: DataFrame, n_rows: int, n: int = 5) -> DataFrame:
    """Warm targets from their own profile, cold ones from their nearest user's, popular items else."""
    from recjobs.operators.prep import empty_profiles

    cold = empty_profiles(targets, ratings)
    lent = ranking.nearest_profiles(cold, user_neighbours(users, cold, ratings, n_rows, 1), ratings)
    profiles = ratings.join(targets, "user_id", "left_semi").unionByName(lent)
    scores = ranking.item_scores(profiles, weights, items.filter("active").select("item_id"))
    lists = ranking.top_n(ranking.unseen(scores, ratings), n)
    return ranking.with_fallback(lists, targets, ranking.popularity(ratings, items), items, n)


def _self_trained(ratings: DataFrame, items: DataFrame, targets: DataFrame, fit: Callable[[DataFrame], DataFrame], added: list[int], n: int) -> DataFrame:
    everyone = ratings.select("user_id").distinct()

    def recommend(explicit: DataFrame, weights: DataFrame, m: int) -> DataFrame:
        return recommend_with(explicit, weights, items, everyone, m)

    return recommend_with(ratings, hybrid.self_training(ratings, fit, recommend, added), items, targets, n)


def enriched_slim(ratings: DataFrame, items: DataFrame, targets: DataFrame, near: DataFrame, alpha: float, added: list[int], n: int = 5) -> DataFrame:
    """Self-training: ridge weights on the neighbours given (of content, say), profiles enriched phase
    by phase with implicit ratings; lists are made from the explicit ones. The Gram table is kept up by the
    pairs that a phase adds."""
    kept: list[tuple[DataFrame, DataFrame]] = []  # the ratings last fitted on, and their Gram table

    def fit(enriched: DataFrame) -> DataFrame:
        if not kept:
            table = linear.gram(enriched)
        else:
            before, gram = kept.pop()
            table = linear.gram_added(gram, before, enriched.join(before.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti"))
        kept.append((enriched, materialize(table, "gram")))
        return linear.slim_ridge(near, kept[0][1], alpha)

    return _self_trained(ratings, items, targets, fit, added, n)


def enriched_scm(ratings: DataFrame, items: DataFrame, targets: DataFrame, near: DataFrame, kind: str, c: float, added: list[int], n: int = 5) -> DataFrame:
    """Self-training with classifiers "rated or not" on the neighbours given, in place of the ridge."""
    return _self_trained(ratings, items, targets, lambda enriched: linear.scm(near, enriched, kind, c), added, n)
