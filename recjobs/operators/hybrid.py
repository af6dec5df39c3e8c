"""Blends of weight tables, enriched profiles and merged lists."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from recjobs.functions.columns import rounded
from recjobs.functions.kernels import lottery_merge
from recjobs.functions.storage import materialize
from recjobs.operators.prep import implicit, max_abs_scale


def blend(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """share * a + (1 - share) * b, each scaled per target by its largest weight."""
    x = max_abs_scale(a).withColumnRenamed("weight", "wa")
    y = max_abs_scale(b).withColumnRenamed("weight", "wb")
    mixed = F.lit(share) * F.coalesce("wa", F.lit(0.0)) + F.lit(1.0 - share) * F.coalesce("wb", F.lit(0.0))
    return x.join(y, ["src_id", "dst_id"], "full_outer").select("src_id", "dst_id", rounded(mixed).alias("weight"))


def enrich(ratings: DataFrame, recs: DataFrame) -> DataFrame:
    """Profiles and their predicted items, all with rating 1."""
    return ratings.select("user_id", "item_id").unionByName(recs.select("user_id", "item_id")).distinct().withColumn("rating", F.lit(1.0))


def self_training(ratings: DataFrame, fit: Callable[[DataFrame], DataFrame], recommend: Callable[[DataFrame, DataFrame, int], DataFrame], added: list[int]) -> DataFrame:
    """Fit on implicit ratings, add each user's best items, fit again; returns the last weights.
    ``fit(ratings)`` gives weights, ``recommend(ratings, weights, n)`` lists; each phase is written
    before the next."""
    enriched = implicit(ratings)
    for n in added:
        weights = materialize(fit(enriched), "weights")
        enriched = materialize(enrich(enriched, recommend(ratings, weights, n)), "enriched")
    return materialize(fit(enriched), "weights")


def draws(seed: int, user: int, steps: int) -> Iterator[float]:
    """Numbers in [0, 1) of a user: md5 of seed, user and step, so other engines can draw them, too."""
    for step in range(steps):
        yield int(hashlib.md5(f"{seed}:{user}:{step}".encode()).hexdigest()[:8], 16) / (1 << 32)


def lottery(lists: list[DataFrame], shares: list[float], n: int = 5, seed: int = 1, decay: float = 1.5) -> DataFrame:
    """``(user_id, rank, item_id, source)``: one merged list a user, drawn from several ranked ones.
    Draws depend on the seed and the user alone. A user of no list has no row; a user of short lists
    gets what they hold."""
    rows, n_lists = None, len(lists)
    for k, recs in enumerate(lists):
        own = recs.select("user_id", "item_id", "rank", F.lit(k).alias("source"))
        rows = own if rows is None else rows.unionByName(own)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        user = int(pdf["user_id"].iloc[0])
        ranked = [pdf[pdf["source"] == k].sort_values("rank")["item_id"].tolist() for k in range(n_lists)]
        out = lottery_merge(ranked, shares, n, draws(seed, user, len(pdf)), decay)
        return pd.DataFrame({"user_id": user, "rank": range(1, len(out) + 1), "item_id": [x for x, _ in out], "source": [k for _, k in out]})

    return rows.groupBy("user_id").applyInPandas(run, "user_id long, rank int, item_id long, source int")


def coin_flip(a: DataFrame, b: DataFrame, n: int = 5, seed: int = 1) -> DataFrame:
    """A fair draw between two lists for each place."""
    return lottery([a, b], [0.5, 0.5], n, seed, decay=1.0)


def source_frequencies(merged: DataFrame) -> DataFrame:
    """``(source, rank, n)``: how often each list gave each place."""
    return merged.groupBy("source", "rank").agg(F.count("*").alias("n"))


def stacked_blocks(blocks: list[DataFrame]) -> DataFrame:
    """Rows of several content tables under each other; ids of different kinds must not clash."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out
