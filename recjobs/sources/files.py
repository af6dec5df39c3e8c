"""Text files of profiles, interactions, recommendations, scores and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ITEM_SCHEMA = (
    "id long, title string, career_level int, discipline_id int, industry_id int, country string, region int, "
    "latitude double, longitude double, employment int, tags string, created_at long, active_during_test int"
)
USER_SCHEMA = (
    "user_id long, jobroles string, career_level int, discipline_id int, industry_id int, country string, region int, "
    "experience_n_entries_class int, experience_years_experience int, experience_years_in_current int, "
    "edu_degree int, edu_fieldofstudies string"
)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows with a header, by an explicit schema; empty fields are null."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_items(spark: SparkSession, path: str, schema: str = ITEM_SCHEMA) -> DataFrame:
    """Item profiles; a missing career level is 0."""
    return read_tsv(spark, path, schema).fillna(0, ["career_level"])


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """``(user_id, item_id, rating)``; the ratings of a repeated pair add up."""
    rows = read_tsv(spark, path, "user_id long, item_id long, interaction_type int")
    return rows.groupBy("user_id", "item_id").agg(F.sum("interaction_type").cast("double").alias("rating"))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """User profiles; missing numbers are 0."""
    numbers = ["career_level", "experience_n_entries_class", "experience_years_experience", "experience_years_in_current", "edu_degree"]
    return read_tsv(spark, path, USER_SCHEMA).fillna(0, numbers)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """``(user_id)`` of a CSV with a header."""
    return spark.read.csv(path, header=True, schema="user_id long")


def pack(recs: DataFrame) -> DataFrame:
    """``(user_id, recommended_items)``: a user's items in rank order, joined by blanks."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return recs.groupBy("user_id").agg(F.array_join(F.transform(ranked, lambda x: x["item_id"].cast("string")), " ").alias("recommended_items"))


def unpack(packed: DataFrame) -> DataFrame:
    """``(user_id, rank, item_id)`` of packed recommendations."""
    return packed.select("user_id", F.posexplode(F.split(F.trim("recommended_items"), " +")).alias("p", "item")).select("user_id", (F.col("p") + 1).alias("rank"), F.col("item").cast("long").alias("item_id"))


def write_recommendations(recs: DataFrame, path: str, user_names: DataFrame | None = None, item_names: DataFrame | None = None) -> None:
    """A CSV of packed lists; optional tables ``(user_id, name)`` / ``(item_id, name)`` give natural ids."""
    for names, key in ((user_names, "user_id"), (item_names, "item_id")):
        if names is not None:
            recs = recs.join(names.withColumnRenamed("name", "_name"), key).drop(key).withColumnRenamed("_name", key)
    pack(recs).write.csv(path, header=True)


def read_recommendations(spark: SparkSession, path: str) -> DataFrame:
    """``(user_id, rank, item_id)`` of a file that ``write_recommendations`` wrote, by numbers."""
    return unpack(spark.read.csv(path, header=True, schema="user_id long, recommended_items string"))


def write_weights(weights: DataFrame, path: str) -> None:
    """Persist a weight table."""
    weights.write.parquet(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """A persisted weight table."""
    return spark.read.schema("src_id long, dst_id long, weight double").parquet(path)


def write_similarities(dots: DataFrame, shrinks: list[int], path: str) -> None:
    """One table of kNN candidates for several shrink values, from dots and co-counts made once."""
    from recjobs.operators.similarity import shrunk

    each = dots.withColumn("shrink", F.explode(F.array(*(F.lit(s) for s in shrinks))))
    each.select("i", "j", shrunk(F.col("dot"), F.col("co"), F.col("shrink")).alias("sim"), "shrink").write.partitionBy("shrink").parquet(path)


def read_similarities(spark: SparkSession, path: str, shrink: int) -> DataFrame:
    """The table of one shrink value; only its folder is read."""
    return spark.read.parquet(path).filter(F.col("shrink") == shrink).select("i", "j", "sim")


def write_popularity(popularity: DataFrame, path: str, n: int = 500) -> None:
    """The first n items of the popularity order, one column."""
    popularity.orderBy("rank").limit(n).select(F.col("item_id").alias("0")).coalesce(1).write.csv(path, header=True)


def read_popularity(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, item_id)``: one short file, so lines keep their order."""
    rows = spark.read.csv(path, header=True, schema="item_id long").withColumn("line", F.monotonically_increasing_id())
    return rows.select(F.row_number().over(Window.orderBy("line")).alias("rank"), "item_id")


def write_scores(scores: DataFrame, path: str) -> None:
    """A TSV of one file: score tables have a row a setting."""
    scores.coalesce(1).write.csv(path, sep="\t", header=True)


def write_probabilities(predicted: DataFrame, path: str, classes: int) -> None:
    """``id, p_0 .. p_(classes-1)`` from a ``probability`` array."""
    predicted.select("id", *(F.get("probability", F.lit(c)).alias(f"p_{c}") for c in range(classes))).write.csv(path, header=True)
