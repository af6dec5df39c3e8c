"""Column expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def rounded(x: Column) -> Column:
    """Six decimals, halves up, in double arithmetic alone: the same in other SQL engines."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def best(df: DataFrame, by: str, score: str, tie: str, n: int, rank: str = "rank") -> DataFrame:
    """The n rows of largest score within each key, ties to the smaller id, numbered from 1."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def md5_order(seed: int, *cols: str) -> Column:
    """A random-looking order that doesn't depend on partitions or the engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))
