"""Texts of repeated fits are split into words once."""

from pyspark.sql import functions as F

from recjobs.operators import classify


def test_texts_are_read_once(spark):
    docs = spark.createDataFrame([(k, None if k % 11 == 0 else f"word{k % 3} more", k % 3) for k in range(60)], "id long, text string, label int")
    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        met.add(1)
        return text

    found = classify.repeated_predictions(docs.select("id", told("text").alias("text"), "label"), 2, 0.001)
    assert met.value == 60
    want = {}
    for rep in range(2):
        of_rep = docs.join(classify.stratified_split(docs.select("id", "label"), 2, 0.25, 1).filter(F.col("rep") == rep).select("id", "test"), "id")
        model = classify.text_classifier(of_rep.filter("not test"), 0.001, 0.0)
        want |= {(rep, r.id): (r.prediction, round(r.probability[r.label], 6)) for r in classify.class_probabilities(model, of_rep.filter("test")).collect()}
    assert {(r.rep, r.id): (r.prediction, round(r.probability, 6)) for r in found.collect()} == want
