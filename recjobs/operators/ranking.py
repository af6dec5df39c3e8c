"""Scores, masks, top-n lists and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from recjobs.functions.columns import best, rounded
from recjobs.functions.storage import materialize
from recjobs.operators.prep import dense_index


HEAD = 256  # first places of a list, which most users meet and which therefore travel to them


def popularity(ratings: DataFrame, items: DataFrame, by: str = "count") -> DataFrame:
    """``(item_id, score, rank)`` of all items: number of raters, or sum of ratings; 0 if unrated.

    Items are numbered by ranges, so no task holds them all."""
    value = F.count("*").cast("double") if by == "count" else F.sum("rating")
    scored = items.select("item_id").join(ratings.groupBy("item_id").agg(value.alias("score")), "item_id", "left")
    scored = scored.select("item_id", rounded(F.coalesce("score", F.lit(0.0))).alias("score"))
    numbered = dense_index(scored.select(F.struct((-F.col("score")).alias("less"), "item_id").alias("key")), "key")
    return numbered.select("key.item_id", (0.0 - F.col("key.less")).alias("score"), (F.col("idx") + 1).cast("int").alias("rank"))


def popular_unseen(popular: DataFrame, items: DataFrame, ratings: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """The n best active items that each target has not rated; fewer if there are not so many.

    Of a target's places in the list s_0 < s_1 < ... that it has rated, s_i - i places before s_i are
    free. So its m-th free place (from 0) is m plus the number of i with s_i - i <= m: one window of its own
    profile and n sums, however long that is. A target is served once, null ones are left out."""
    head = dense_index(popular.join(items.filter("active"), "item_id", "left_semi").select(F.struct("rank", "item_id", "score").alias("key")), "key")
    head = materialize(head.select("idx", "key.item_id", "key.score"), "head")
    asked = targets.select("user_id").filter("user_id is not null").distinct()
    mine = ratings.select("user_id", "item_id").distinct().join(asked, "user_id", "left_semi").join(head.select("item_id", "idx"), "item_id")
    before = F.col("idx") - F.row_number().over(Window.partitionBy("user_id").orderBy("idx")) + 1
    skipped = [F.count_if(F.col("before") <= m) for m in range(n)]
    told = mine.select("user_id", before.alias("before")).groupBy("user_id").agg(F.array(*skipped).alias("skipped"))
    none = F.array(*(F.lit(0).cast("long") for _ in range(n)))
    places = asked.join(told, "user_id", "left").select("user_id", F.posexplode(F.coalesce("skipped", none)).alias("m", "over"))
    placed = places.select("user_id", (F.col("m") + F.col("over")).alias("idx"), (F.col("m") + 1).alias("rank"))
    first, rest = (placed.filter(c).join(f(head.filter(c)), "idx") for c, f in ((F.col("idx") < HEAD, F.broadcast), (F.col("idx") >= HEAD, lambda x: x)))
    return first.unionByName(rest).select("user_id", "item_id", "score", "rank")


def item_scores(ratings: DataFrame, weights: DataFrame, active: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """Sum of rating * weight over a user's items; inactive targets go before the join."""
    if active is not None:
        weights = weights.join(active.select(F.col("item_id").alias("dst_id")), "dst_id", "left_semi")
    joined = ratings.join(weights.withColumnRenamed("src_id", "item_id"), "item_id")
    top, below = F.sum(F.col("rating") * F.col("weight")), F.sum("weight")
    score = top / F.when(F.abs(below) < 1e-6, 1.0).otherwise(below) if normalize else top
    return joined.groupBy("user_id", F.col("dst_id").alias("candidate")).agg(rounded(score).alias("score")).withColumnRenamed("candidate", "item_id")


def neighbour_scores(ratings: DataFrame, neighbours: DataFrame, active: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """The list belongs to the candidate: i's neighbours j are looked up among what the user rated."""
    return item_scores(ratings, neighbours.select(F.col("j").alias("src_id"), F.col("i").alias("dst_id"), F.col("sim").alias("weight")), active, normalize)


def user_scores(ratings: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights between users: sum of weight * rating of the others."""
    joined = weights.withColumnRenamed("src_id", "user_id").join(ratings, "user_id")
    return joined.groupBy(F.col("dst_id").alias("to"), "item_id").agg(rounded(F.sum(F.col("weight") * F.col("rating"))).alias("score")).withColumnRenamed("to", "user_id")


def with_sigmoid(scores: DataFrame) -> DataFrame:
    """Raw sums with the probability that they stand for; ranks stay by the sum."""
    return scores.withColumn("probability", rounded(1 / (1 + F.exp(-F.col("score")))))


def unseen(scores: DataFrame, ratings: DataFrame) -> DataFrame:
    """Scores of items that the user has not rated."""
    return scores.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def top_n(scores: DataFrame, n: int) -> DataFrame:
    """The n items of largest score above 0 of each user, ties to the smaller id; no row for the rest."""
    return best(scores.filter("score > 0"), "user_id", "score", "item_id", n).select("user_id", "item_id", "score", "rank")


def with_fallback(recs: DataFrame, targets: DataFrame, popular: DataFrame, items: DataFrame, n: int, ratings: DataFrame | None = None) -> DataFrame:
    """Targets without any item get the n most popular active ones (unseen ones if ratings are given)."""
    left = targets.select("user_id").join(recs, "user_id", "left_anti")
    if ratings is not None:
        return recs.unionByName(popular_unseen(popular, items, ratings, left, n).withColumn("score", F.lit(0.0)))
    head = popular.join(items.filter("active"), "item_id", "left_semi").orderBy("rank").limit(n)
    lists = head.select("item_id", F.lit(0.0).alias("score"), F.row_number().over(Window.orderBy("rank")).alias("rank"))
    return recs.unionByName(left.crossJoin(F.broadcast(lists)))  # n rows


def padded(recs: DataFrame, targets: DataFrame, popular: DataFrame, items: DataFrame, ratings: DataFrame, n: int) -> DataFrame:
    """Lists of fewer than n items (or none) filled up to n with the most popular active items that the
    target has neither rated nor listed, at score 0, after its own; fewer where there are not so many."""
    own = recs.groupBy("user_id").agg(F.count("*").alias("own"))
    short = targets.select("user_id").distinct().join(own, "user_id", "left").select("user_id", F.coalesce("own", F.lit(0)).alias("own")).filter(F.col("own") < n)
    taken = ratings.select("user_id", "item_id").unionByName(recs.select("user_id", "item_id"))
    more = popular_unseen(popular, items, taken, short, n).join(short, "user_id").withColumn("rank", (F.col("rank") + F.col("own")).cast("int"))
    return recs.unionByName(more.filter(F.col("rank") <= n).select("user_id", "item_id", F.lit(0.0).alias("score"), "rank").select(recs.columns))


def nearest_profiles(cold: DataFrame, neighbours: DataFrame, ratings: DataFrame) -> DataFrame:
    """Cold users with the ratings of their nearest user."""
    one = neighbours.filter("rank = 1").select(F.col("i").alias("cold_id"), F.col("j").alias("user_id"))
    one = one.join(cold.select(F.col("user_id").alias("cold_id")), "cold_id", "left_semi")
    return one.join(ratings, "user_id").select(F.col("cold_id").alias("user_id"), "item_id", "rating")
