"""What operators hold of their rows at a time."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from recjobs.llm import importance, queries
from recjobs.llm.textvec import slices

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_warc", "op13_importance"])
def test_queries_pass_small_batches(spark, name):
    """Pages and texts don't go to workers ten thousand at a time."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    spark.conf.unset(LIMIT)
    queries.QUERIES[name](spark, SF_DIR)
    rows = spark.range(0, 300, 1, 1).selectExpr("repeat(cast(id as string), 30000) AS text")
    assert max(r.size for r in rows.mapInArrow(sizes, "size long").collect()) < 5 << 20
    spark.conf.set(LIMIT, "1024b")
    queries.QUERIES[name](spark, SF_DIR)
    assert spark.conf.get(LIMIT) == "1024b"
    spark.conf.unset(LIMIT)


@pytest.mark.parametrize("n_texts, most", [(1_500, 50 << 20), (1, 80 << 20)])
def test_ngrams_of_a_slice_are_few_objects(n_texts, most):
    """2 MB of words, as many texts or as a single one, which is a slice whatever its length."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(20_000)}" for _ in range(350_000)]
    a_text = len(words) // n_texts
    batch = pa.record_batch({"text": [" ".join(words[k * a_text : (k + 1) * a_text]) for k in range(n_texts)]})
    tracemalloc.start()
    n = sum(len(importance.ngram_buckets(part.column(0), 2, 10_000)[0]) for part in slices(batch, size=importance.SLICE_BYTES))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == n_texts * (2 * a_text - 1) and peak < most, peak
