"""Importance resampling towards a target distribution, by hashed word n-grams.

A task numbers the words of a slice of texts and sorts the places of that sequence by the words that
follow (a suffix array, sorted as deep as an n-gram is long). Places that share an n-gram stand side by
side there: a run of common prefixes (LCP) of n words or more is one n-gram with all its occurrences. Each
run's n-gram is hashed once, and its bucket is scattered back to the occurrences. Buckets of the
documents are written, counted over the corpus, and read again to be scored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from recjobs.functions.storage import materialize
from recjobs.functions.workers import small_batches
from recjobs.llm.textvec import Texts, slices

SLICE_BYTES = 1 << 20  # of text that one suffix array covers, unless a single text is longer
BUCKET = np.dtype("<i4")  # of a bucket's number as it is written
HASHED_AT_ONCE = 1 << 16  # n-grams, which are Python objects meanwhile

#: Bytes of the word definition [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after A-Z became a-z
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of a sequence in the order of what follows, to ``depth`` entries at least; ties stand in
    any order. Ranks by the first 1, 2, 4, ... entries come from those by half as many."""
    rank, known = ids.astype(np.int64), 1
    while known < depth:
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - known)] = rank[known:] + 1
        _, rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)
        known *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many entries, up to ``depth``, each suffix shares with the one before it; 0 ends a text."""
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    shared, alike = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for k in range(depth):
        here = padded[order + k]
        alike &= (here[1:] == here[:-1]) & (here[1:] > 0)
        shared[1:] += alike
    return shared


def ngram_buckets(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every run of 1 to n words: all of the first text, of the second, and so on; how many
    each text has; and each text's number of words."""
    plain = Texts(texts, lower=True)
    inside = WORD_BYTE[plain.bytes]
    starts, ends, first = plain.ranges(inside)
    n_words = np.diff(first)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(plain.bytes[inside])) if len(starts) else pa.array([], pa.large_string())
    numbered = words.dictionary_encode()
    names = numbered.dictionary.cast(pa.large_binary()).to_pylist()
    # ids from 1; a 0 after each text, so that nothing runs on into the next
    ids = np.insert(numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, first[1:], 0)
    text = np.repeat(np.arange(len(n_words)), n_words + 1)
    left = np.cumsum(n_words + 1)[text] - 1 - np.arange(len(ids))  # words from here to the text's end

    order = suffix_array(ids, n)
    shared = common_prefixes(ids, order, n)
    found, of_text = [], []
    for length in range(1, n + 1):
        whole = left[order] >= length
        place, run = order[whole], np.cumsum(shared[whole] < length) - 1
        heads = place[np.flatnonzero(np.diff(run, prepend=-1))]
        hashed = np.empty(len(heads), np.int32)
        for at in range(0, len(heads), HASHED_AT_ONCE):
            some = heads[at : at + HASHED_AT_ONCE]
            parts = [ids[some + k].tolist() for k in range(length)]
            hashed[at : at + len(some)] = [zlib.crc32(names[p[0] - 1] if length == 1 else b" ".join([names[i - 1] for i in p])) % buckets for p in zip(*parts)]
        bucket = np.full(len(ids), -1, np.int32)
        bucket[place] = hashed[run]  # back to all occurrences
        found.append(bucket[bucket >= 0])
        of_text.append(text[bucket >= 0])
    where = np.argsort(np.concatenate(of_text), kind="stable")
    return np.concatenate(found)[where], np.maximum(n_words[:, None] - np.arange(n), 0).sum(1), n_words


def bucket_table(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """``(doc_id, n_words, buckets binary)`` of rows ``(doc_id, text)``, written. A text's buckets are one
    value of 32-bit integers, as Spark takes arrays apart into objects and copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                found, sizes, n_words = ngram_buckets(part.column(1), n, buckets)
                cuts = BUCKET.itemsize * np.concatenate([[0], np.cumsum(sizes)])
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(found.astype(BUCKET))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), packed.cast(pa.binary())], ["doc_id", "n_words", "buckets"])

    return materialize(texts.mapInArrow(run, "doc_id long, n_words long, buckets binary"), "buckets")


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column of ``bucket_table``, and where each text's begin, with the end."""
    column = column.cast(pa.large_binary())
    first = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // BUCKET.itemsize
    data = column.buffers()[2]
    held = np.frombuffer(data, BUCKET, int(first[-1])) if data is not None else np.empty(0, BUCKET)
    return held[first[0] : first[-1]], first - first[0]


def bucket_totals(table: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket, over all rows: a task adds up its own, and at most
    ``buckets`` sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            totals += np.bincount(unpacked(batch.column(0))[0], minlength=buckets)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(totals[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in table.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of smoothed shares, floored: how much likelier the target's feature is."""
    n, all_raw, all_target = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_raw + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def gumbel(seed: int, key: Column) -> Column:
    """1000 times Gumbel noise, floored, from the first 32 bits of sha256(``seed:key``)."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Places (from 1) of all rows in a total order: one range shuffle, and sums over its tasks."""
    sorted_rows = materialize(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    sorted_rows = sorted_rows.withColumn("task", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    # one row a task, as many as the shuffle has partitions
    ahead = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = sorted_rows.groupBy("task").agg(F.count("*").alias("size")).select("task", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"))
    return sorted_rows.join(F.broadcast(before), "task").withColumn(rank, F.col("before") + F.col("at") + 1).drop("task", "at", "before")


def importance_resampling(
    docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, share: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of each row; ``rank`` numbers the drawn rows.

    Of rows with ``least_words`` words or more, ``share`` percent (floored) of highest score are drawn,
    ties to the smaller id, rows without an id last. Null and empty texts, and those without a word, have
    no features and weight 0. An empty target leaves all weight to the documents' own frequencies. Rows
    that repeat are drawn each for itself; other columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    table = bucket_table(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), n, buckets)
    aim = bucket_table(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_col).alias("text")), n, buckets)
    gains = bucket_gains(bucket_totals(table, buckets), bucket_totals(aim, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, first = unpacked(batch.column(2))
            total = np.concatenate([[0], np.cumsum(gains[held])])
            sizes = np.diff(first)
            sums = total[first[1:]] - total[first[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(sums // np.maximum(sizes, 1))], ["doc_id", "n_words", "n_features", "weight"])

    weighed = table.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))
    scored = materialize(weighed.withColumn("asked", F.col("n_words") >= least_words), "scored")
    drawn = scored.filter("asked").count() * share // 100
    placed = ranked(scored, [F.desc("asked"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")], "place")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("asked") & (F.col("place") <= drawn), F.col("place")).alias("rank"))
