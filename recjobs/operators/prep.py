"""Cleaning, projections, filters and aggregations of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from recjobs.functions.columns import rounded
from recjobs.functions.storage import materialize


def max_per_pair(raw: DataFrame) -> DataFrame:
    """``(user_id, item_id, rating)``, one row a pair: the largest type. A pair whose types are all null has
    a null rating; null ids are ids of their own."""
    return raw.groupBy("user_id", "item_id").agg(F.max("interaction_type").cast("double").alias("rating"))


def sum_per_pair(raw: DataFrame) -> DataFrame:
    """``(user_id, item_id, rating)``, one row a pair: the sum of its types."""
    return raw.groupBy("user_id", "item_id").agg(F.sum("interaction_type").cast("double").alias("rating"))


def dense_index(ids: DataFrame, key: str) -> DataFrame:
    """``(key, idx)``, from 0 in key order, without bringing all ids to one task: ids are dealt by
    range, counted per partition, and numbered within."""
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.select(key).distinct().repartitionByRange(n, key).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return dealt.withColumn("n", within).join(starts, "part").select(key, (F.col("start") + F.col("n") - 1).cast("long").alias("idx"))


def unknown_ids(raw: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """``(kind, id, n)``: ids of interactions that no profile has."""
    parts = []
    for kind, key, known in (("user", "user_id", users), ("item", "item_id", items)):
        parts.append(raw.groupBy(key).agg(F.count("*").alias("n")).join(known, key, "left_anti").select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "n"))
    return parts[0].unionByName(parts[1])


def item_strength(raw: DataFrame) -> DataFrame:
    """Sum over users of each pair's largest type."""
    return max_per_pair(raw).groupBy("item_id").agg(F.sum("rating").alias("strength"))


def user_activity(raw: DataFrame) -> DataFrame:
    """Distinct items a user; repeats count once, null items don't count."""
    return raw.groupBy("user_id").agg(F.countDistinct("item_id").alias("n_items"))


def activity_groups(raw: DataFrame) -> DataFrame:
    """One row: users above 50 items, with at most 50, with at most 2. Zeros for an empty table."""
    n = F.col("n_items")
    return user_activity(raw).agg(F.count_if(n > 50).alias("above_50"), F.count_if(n <= 50).alias("at_most_50"), F.count_if(n <= 2).alias("at_most_2"))


def histogram(df: DataFrame, column: str, width: int) -> DataFrame:
    """``(bin_start, n)`` of equal-width bins."""
    return df.groupBy((F.floor(F.col(column) / width) * width).cast("long").alias("bin_start")).agg(F.count("*").alias("n"))


def describe_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, mean, deviation, least, quartiles, largest."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    q = lambda p: rounded(F.percentile("v", F.lit(p)))
    return long.groupBy("name").agg(F.count("v").alias("n"), rounded(F.avg("v")).alias("mean"), rounded(F.stddev("v")).alias("std"), F.min("v").alias("least"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("v").alias("largest"))


def describe_strings(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, distinct values, the most frequent one (ties: the first) and how often."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in columns))).alias("x")).select("x.*").filter("v is not null")
    counts = long.groupBy("name", "v").agg(F.count("*").alias("c"))
    top = F.min_by("v", F.struct(-F.col("c"), F.col("v")))
    return counts.groupBy("name").agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), top.alias("top"), F.max("c").alias("freq"))


def implicit(ratings: DataFrame) -> DataFrame:
    """Every positive rating becomes 1; zero, negative and null ones go."""
    return ratings.filter("rating > 0").withColumn("rating", F.lit(1.0))


def global_effects(ratings: DataFrame) -> DataFrame:
    """``(user_id, item_id, rating, mu, item_bias, user_bias, residual)``, biases as means of what is
    left after the ones before. Aggregates are joined back, so that a popular item isn't one task's."""
    mu = ratings.agg(F.avg("rating").alias("mu"))
    centred = ratings.crossJoin(F.broadcast(mu)).withColumn("d", F.col("rating") - F.col("mu"))  # mu is one row
    item = centred.groupBy("item_id").agg(F.avg("d").alias("item_bias"))
    with_item = centred.join(item, "item_id").withColumn("d", F.col("d") - F.col("item_bias"))
    user = with_item.groupBy("user_id").agg(F.avg("d").alias("user_bias"))
    return with_item.join(user, "user_id").select("user_id", "item_id", "rating", "mu", "item_bias", "user_bias", (F.col("d") - F.col("user_bias")).alias("residual"))


def active_items(items: DataFrame) -> DataFrame:
    """Ids of items that may be recommended; a null flag counts as inactive."""
    return items.filter("active").select("item_id")


def of_targets(ratings: DataFrame, targets: DataFrame) -> DataFrame:
    """The ratings of target users."""
    return ratings.join(targets, "user_id", "left_semi")


def empty_profiles(targets: DataFrame, ratings: DataFrame) -> DataFrame:
    """Targets without any rating, each once."""
    return targets.select("user_id").distinct().join(ratings, "user_id", "left_anti")


def l2_normalize(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """Divide by the key's norm + 1e-6. The norm is aggregated first and joined, which splits well."""
    norms = df.groupBy(*key).agg(F.sqrt(F.sum(F.col(column) * F.col(column))).alias("norm"))
    return df.join(norms, key).withColumn(column, F.col(column) / (F.col("norm") + F.lit(1e-6))).drop("norm")


def max_abs_scale(weights: DataFrame) -> DataFrame:
    """Scale each target's weights by the largest of them (0 stays 0)."""
    top = weights.groupBy("dst_id").agg(F.max(F.abs("weight")).alias("top"))
    return weights.join(top, "dst_id").select("src_id", "dst_id", (F.col("weight") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("weight"))
