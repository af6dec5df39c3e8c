"""Classifiers on content, and how they err."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from recjobs.functions.columns import rounded
from recjobs.functions.storage import materialize


def stratified_split(labels: DataFrame, repetitions: int, test_share: float, seed: int) -> DataFrame:
    """``(rep, id, label, test)``: of each label the first floor(share * count) by seeded hash."""
    reps = labels.withColumn("rep", F.explode(F.array(*(F.lit(r) for r in range(repetitions)))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("id").cast("string")))
    own = Window.partitionBy("rep", "label")
    row = F.row_number().over(own.orderBy(key, "id"))
    return reps.withColumn("test", row <= F.floor(F.lit(test_share) * F.count("*").over(own)))


def log_loss(predicted: DataFrame, eps: float = 1e-15) -> DataFrame:
    """``(log_loss, n)`` of ``(label, probability)``, the probability being the label's own."""
    p = F.least(F.greatest(F.col("probability"), F.lit(eps)), F.lit(1 - eps))
    return predicted.agg(rounded(F.avg(-F.log(p))).alias("log_loss"), F.count("*").alias("n"))


def confusion(predicted: DataFrame, repetitions: int) -> DataFrame:
    """``(label, prediction, mean_n)``: counts averaged over repetitions."""
    return predicted.groupBy("label", "prediction").agg(rounded(F.count("*") / F.lit(float(repetitions))).alias("mean_n"))


def weak_classes(confused: DataFrame, least: float = 1.8) -> DataFrame:
    """Confusions of the classes that are right ``least`` times or less on average."""
    right = confused.groupBy("label").agg(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("mean_n")).otherwise(0.0)).alias("right"))
    weak = right.filter(F.col("right") <= least)
    return confused.join(weak, "label").filter("label <> prediction and mean_n > 0")


def _hashed_words(features: int) -> list:
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    return [RegexTokenizer(inputCol="text", outputCol="_words", pattern="[^a-z0-9_]+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)]


def word_counts(docs: DataFrame, features: int = 4096) -> DataFrame:
    """``(id, label, _tf)`` of ``(id, text, label)``, written once: what several classifiers are fitted on."""
    from pyspark.ml import PipelineModel

    counted = PipelineModel(_hashed_words(features)).transform(docs.fillna("", ["text"]))
    return materialize(counted.select("id", "label", "_tf"), "words")


def text_classifier(docs: DataFrame, penalty: float, l1_ratio: float, features: int = 4096):
    """Logistic regression on hashed TF-IDF words of ``(id, text, label)``, or of ``word_counts``; returns the
    fitted pipeline, or None where there is no labelled row. A null text is a document without words; rows
    without a label teach nothing."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF

    words = [] if "_tf" in docs.columns else _hashed_words(features)
    stages = [*words, IDF(inputCol="_tf", outputCol="features"), LogisticRegression(regParam=penalty, elasticNetParam=l1_ratio, maxIter=20)]
    labelled = docs.filter("label is not null")
    labelled = labelled.fillna("", ["text"]) if words else labelled
    return None if labelled.isEmpty() else Pipeline(stages=stages).fit(labelled)


def class_probabilities(model, docs: DataFrame) -> DataFrame:
    """``(id, label, prediction, probability array)`` of a fitted pipeline; a null text is a document
    without words. Without a pipeline (None) there are no rows."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return docs.select("id", "label", F.lit(None).cast("int").alias("prediction"), F.array().cast("array<double>").alias("probability")).limit(0)
    docs = docs if "_tf" in docs.columns else docs.fillna("", ["text"])
    return model.transform(docs).select("id", "label", F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability").alias("probability"))


def repeated_predictions(docs: DataFrame, repetitions: int, penalty: float, l1_ratio: float = 0.0, test_share: float = 0.25, seed: int = 1) -> DataFrame:
    """``(rep, id, label, prediction, probability)`` of the test rows of each repetition of a stratified
    split, by a model fitted on its other rows; ``probability`` is that of the row's own label. Rows
    without a label are left out; an empty table gives no rows."""
    docs = word_counts(docs.filter("label is not null"))  # texts are read and split once
    split = materialize(stratified_split(docs.select("id", "label"), repetitions, test_share, seed), "split")
    out = None
    for rep in range(repetitions):  # models to fit, not data
        of_rep = docs.join(split.filter(F.col("rep") == rep).select("id", "test"), "id")
        found = class_probabilities(text_classifier(of_rep.filter("not test"), penalty, l1_ratio), of_rep.filter("test"))
        one = found.select(F.lit(rep).alias("rep"), "id", "label", "prediction", F.coalesce(F.get("probability", F.col("label")), F.lit(0.0)).alias("probability"))
        out = one if out is None else out.unionByName(one)
    return materialize(out, "predictions")


def tune_classifier(docs: DataFrame, penalties: list[float], ratios: list[float], repetitions: int = 1, test_share: float = 0.25, seed: int = 1) -> DataFrame:
    """``(penalty, l1_ratio, rep, log_loss)`` over a grid, by stratified splits; no rows for an empty table."""
    docs = docs.filter("label is not null")
    split = stratified_split(docs.select("id", "label"), repetitions, test_share, seed)
    out = []
    if docs.isEmpty():
        repetitions = 0
    for rep in range(repetitions):
        of_rep = docs.join(split.filter(F.col("rep") == rep).select("id", "test"), "id")
        train, test = of_rep.filter("not test").cache(), of_rep.filter("test")
        for c in penalties:
            for r in ratios:
                p = class_probabilities(text_classifier(train, c, r), test)
                own = p.select("label", F.get("probability", F.col("label")).alias("probability"))
                out.append((c, r, rep, log_loss(own).first()["log_loss"]))
        train.unpersist()
    return docs.sparkSession.createDataFrame(out, "penalty double, l1_ratio double, rep int, log_loss double")
