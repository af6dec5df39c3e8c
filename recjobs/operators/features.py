"""Content features: tokens, counts and TF-IDF as long tables ``(id, attr, token, weight)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recjobs.functions.storage import materialize

WORDS = "([a-z0-9_]+)"
MEAN_DIGITS = 6  # of a value's mean rating, by which a tree orders the values


def tokens(df: DataFrame, key: str, attrs: list[str], null_token: str = "nan") -> DataFrame:
    """``(id, attr, token)``, a row a word; whole numbers stay one word, nulls become null_token."""
    values = [F.struct(F.lit(a).alias("attr"), F.coalesce(F.col(a).cast("string"), F.lit(null_token)).alias("value")) for a in attrs]
    long = df.select(F.col(key).alias("id"), F.explode(F.array(*values)).alias("x"))
    return long.select("id", "x.attr", F.explode(F.regexp_extract_all(F.lower("x.value"), F.lit(WORDS), F.lit(1))).alias("token"))


def token_counts(words: DataFrame) -> DataFrame:
    """``(id, attr, token, weight)``: how often a row's attribute holds the word."""
    return words.groupBy("id", "attr", "token").agg(F.count("*").cast("double").alias("weight"))


def tfidf(counts: DataFrame, n_rows: int, within: list[str]) -> DataFrame:
    """Smooth idf ln((1 + N) / (1 + df)) + 1, then unit length within ``within``: (id, attr) for each
    attribute by itself, (id) for all of them together."""
    df = counts.groupBy("attr", "token").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0 + n_rows) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    weighted = counts.join(df, ["attr", "token"]).select("id", "attr", "token", (F.col("weight") * idf).alias("weight"))
    norms = weighted.groupBy(*within).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighted.join(norms, within).select("id", "attr", "token", (F.col("weight") / F.col("norm")).alias("weight"))


def location(df: DataFrame, country: str, region: str, name: str = "location") -> DataFrame:
    """One word of country and region; a null part is left out."""
    return df.withColumn(name, F.concat_ws("_", F.col(country).cast("string"), F.col(region).cast("string")))


def content_table(df: DataFrame, key: str, one_hot: list[str], texts: list[str], n_rows: int, null_token: str = "nan") -> DataFrame:
    """Counts of the one-hot attributes and TF-IDF of the others."""
    plain = token_counts(tokens(df, key, one_hot, null_token))
    return plain.unionByName(tfidf(token_counts(tokens(df, key, texts, null_token)), n_rows, ["id", "attr"]))


def unified_content(df: DataFrame, key: str, attrs: list[str], n_rows: int, null_token: str = "nan") -> DataFrame:
    """TF-IDF over all attributes together: a row has unit length as a whole."""
    return tfidf(token_counts(tokens(df, key, attrs, null_token)), n_rows, ["id"])


def rating_tfidf(ratings: DataFrame, n_users: int) -> DataFrame:
    """Users as documents, items as terms, ratings as term counts."""
    as_counts = ratings.select(F.col("user_id").alias("id"), F.lit("item").alias("attr"), F.col("item_id").alias("token"), F.col("rating").alias("weight"))
    return tfidf(as_counts, n_users, ["id"]).select(F.col("id").alias("user_id"), F.col("token").alias("item_id"), "weight")


def attribute_importance(ratings: DataFrame, items: DataFrame, attrs: list[str], impurity: str = "gini", depth: int = 5) -> DataFrame:
    """``(attr, importance)`` of a decision tree that predicts the rating from item attributes; of an
    attribute of any number of values.

    Ratings are counted by item and class first, so the tree sees a row an item. In each node an
    attribute's values are ordered by their mean rating (rounded to MEAN_DIGITS, which bounds how many
    places there are to split at), counts are added up along that order, and the split of largest impurity
    fall is taken, ties going to the attribute named first and the smaller mean. All nodes of a level are
    one plan; of it a split a node reaches the driver. Null values are the word nan, null ratings are left
    out. Importances are shares of all impurity falls (0 each without a split); without ratings there are
    no rows."""
    spark = ratings.sparkSession
    rated = ratings.filter("rating is not null")
    classes = [r.rating for r in rated.select("rating").distinct().orderBy("rating").collect()]  # the steps of the scale
    if not classes:
        return spark.createDataFrame([], "attr string, importance double")
    counts = [f"c{n}" for n in range(len(classes))]
    told = rated.groupBy("item_id").agg(*(F.count_if(F.col("rating") == F.lit(c)).alias(n) for c, n in zip(classes, counts)))
    values = [F.coalesce(F.col(a).cast("string"), F.lit("nan")).alias(a) for a in attrs]
    rows = materialize(told.join(items.select("item_id", *values), "item_id").select(*attrs, *counts, F.lit(1).alias("node")), "tree")

    def lost(side: list[Column]) -> Column:
        """Impurity times rows."""
        n = sum(side, F.lit(0.0))
        if impurity == "gini":
            return n - sum((c * c for c in side), F.lit(0.0)) / F.greatest(n, F.lit(1.0))
        return sum((F.when(c > 0, -c * F.log2(c / n)).otherwise(0.0) for c in side), F.lit(0.0))

    fall = dict.fromkeys(attrs, 0.0)
    for _ in range(depth):
        cells = rows.select("node", *counts, F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(a).alias("value")) for k, a in enumerate(attrs)))).alias("x"))
        by_value = cells.groupBy("node", "x.k", "x.value").agg(*(F.sum(c).cast("double").alias(c) for c in counts))
        mean = F.round(sum((F.col(c) * F.lit(float(v)) for c, v in zip(counts, classes)), F.lit(0.0)) / sum((F.col(c) for c in counts), F.lit(0.0)), MEAN_DIGITS)
        by_value = materialize(by_value.withColumn("mean", mean), "values")
        order = Window.partitionBy("node", "k").orderBy("mean").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        places = by_value.groupBy("node", "k", "mean").agg(*(F.sum(c).alias(c) for c in counts))
        whole = by_value.groupBy("node", "k").agg(*(F.sum(c).alias(f"all_{c}") for c in counts))
        sums = places.select("node", "k", "mean", *(F.sum(c).over(order).alias(c) for c in counts)).join(whole, ["node", "k"])
        left, both = [F.col(c) for c in counts], [F.col(f"all_{c}") for c in counts]
        gain = lost(both) - lost(left) - lost([b - x for b, x in zip(both, left)])
        best_split = F.min_by(F.struct("k", "mean", "gain"), F.struct(-F.round("gain", 9), "k", "mean"))
        splits = sums.withColumn("gain", gain).filter("gain > 1e-9").groupBy("node").agg(best_split.alias("s")).select("node", "s.*")
        splits = materialize(splits, "splits")
        found = splits.collect()  # a row a node: 2 ** depth at most
        if not found:
            break
        for r in found:
            fall[attrs[r.k]] += r.gain
        value = F.get(F.array(*map(F.col, attrs)), F.col("k"))
        side = by_value.select("node", "k", "value", "mean").join(splits.select("node", "k", F.col("mean").alias("at")), ["node", "k"])
        side = side.select("node", "value", (F.col("mean") > F.col("at")).cast("int").alias("right"))
        rows = rows.join(splits.select("node", "k"), "node").withColumn("value", value).join(side, ["node", "value"])
        rows = materialize(rows.select(*attrs, *counts, (2 * F.col("node") + F.col("right")).alias("node")), "tree")
    total = sum(fall.values())
    return spark.createDataFrame([(a, x / total if total else 0.0) for a, x in fall.items()], "attr string, importance double")
