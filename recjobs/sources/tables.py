"""The library's tables, made from a star schema of orders (see README)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the directory, all columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


COLD_SEGMENT = "MACHINERY"  # its customers' orders are withheld, so that there are users without a profile
TARGET_SEGMENTS = ("MACHINERY", "BUILDING")


def raw_interactions(spark: SparkSession, sf_dir: str, withhold: bool = True) -> DataFrame:
    """``(user_id, item_id, interaction_type)``; a pair may repeat. ``withhold`` leaves out the users
    that are to be cold."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").cast("long").alias("user_id"))
    if withhold:
        warm = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != COLD_SEGMENT).select(F.col("c_custkey").cast("long").alias("user_id"))
        orders = orders.join(warm, "user_id", "left_semi")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_partkey").cast("long").alias("item_id"), "l_returnflag")
    kind = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    return lines.join(orders, "order").select("user_id", "item_id", kind.alias("interaction_type"))


def event_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns from the event stream: few users and items, many repeats."""
    item = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type").isin("click", "signup"), 2).otherwise(1)
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), item.alias("item_id"), kind.alias("interaction_type")).filter("item_id is not null")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, title, tags, brand, size, active)`` of parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("tags"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"), (F.col("p_size") <= 40).alias("active"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, segment, nation, region)`` of customers."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return customers.join(nation, "nation").select("user_id", "segment", F.col("nation").cast("long").alias("nation"), F.col("region").cast("long").alias("region"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of TARGET_SEGMENTS."""
    return table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin(*TARGET_SEGMENTS)).select(F.col("c_custkey").cast("long").alias("user_id"))
