"""Token counts with a digest cache: texts are counted once a content and tokenizer version.

The cache is a Parquet table ``(tokenizer, content, n_tokens)``, partitioned by tokenizer: both are
digests, of the tokenizer's file with its library's version, and of the normalised content. A run joins
its contents' digests with the stored ones, encodes one text of each content that isn't there, appends
those counts, and joins them to the rows. Two runs that append at a time may store a content twice, with
equal counts; readers take one.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from importlib.metadata import version

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recjobs.functions.storage import materialize
from recjobs.llm.pieces import piece_encoder
from recjobs.llm.textvec import slices

SLICE_BYTES = 1 << 20  # of text encoded at a time
STORED = "content string, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer's version: what is in its file, and the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {version(library)}\n".encode() + f.read()).hexdigest()


class PieceCounter:
    """Counts of a sentencepiece model; a content is the text as the model's normaliser leaves it."""

    def __init__(self, path: str):
        self.encoder = piece_encoder(path)
        self.as_it_is = self.encoder.normalizer.identity

    def contents(self, texts: pa.Array) -> pa.Array:
        return self.encoder.normalize(texts)[0]

    def count(self, texts: pa.Array) -> np.ndarray:
        return self.encoder.encode(self.encoder.normalize(texts)[0])[1] - 1  # without the end id


class JsonCounter:
    """Counts of a ``tokenizers`` file; a content is the text as its normaliser leaves it, unless it may
    hold the name of an added token, which is looked for before the text is normalised."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.as_it_is = self.tokenizer.normalizer is None
        self.added = [t.content.casefold() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def contents(self, texts: pa.Array) -> pa.Array:
        normal = self.tokenizer.normalizer.normalize_str
        own = lambda t: any(name in t.casefold() for name in self.added)
        return pa.array(["\0" + t if own(t) else normal(t) for t in texts.fill_null("").to_pylist()], pa.large_string())

    def count(self, texts: pa.Array) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)
        return np.array([len(e.ids) for e in found], np.int64)


@cache
def counter(path: str) -> PieceCounter | JsonCounter:
    """One a Python worker."""
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def stored_counts(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """``(content, n_tokens)`` that the cache has for a tokenizer's digest, one row a content; a cache
    that isn't there yet is made, without rows."""
    spark.createDataFrame([], STORED).write.mode("ignore").partitionBy("tokenizer").parquet(cache_path)
    held = spark.read.schema(STORED).parquet(cache_path).filter(F.col("tokenizer") == tokenizer)
    return held.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _content(docs: DataFrame, path: str) -> tuple[DataFrame, Column]:
    """Rows ``(doc_id, text)`` with what their digest is taken of; a tokenizer that changes no text has
    its digests taken by Spark itself."""
    if counter(path).as_it_is:
        return docs, F.sha2(F.coalesce("text", F.lit("")), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in counter(path).contents(part.column(1)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.string())], ["doc_id", "text", "digest"])

    return docs.mapInArrow(run, "doc_id long, text string, digest string"), F.col("digest")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, cached)`` of each row; ``cached`` tells whether the cache
    had its content before, and contents that it hadn't are appended.

    Counts are those of the tokenizer's library without begin, end or added special tokens; names of
    special tokens inside texts are its default's matter. A null text counts as empty (0 bytes). Rows that
    repeat, or have no id, are rows of their own; other columns are ignored, whatever their names; an
    empty table gives no rows and leaves the cache as it was.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    source, digest = _content(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer_path)
    source = source.withColumn("content", digest)
    rows = materialize(source.select("doc_id", "content", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "digests")
    stored = stored_counts(spark, cache_path, version)
    misses = materialize(rows.select("content").distinct().join(stored, "content", "left_anti"), "misses")

    # tasks keep one text of each content before any travels; where misses are few, Spark broadcasts them
    # and asks for them before that
    one = source.select("content", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["content"]).join(misses, "content", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counter(tokenizer_path).count(part.column(1)), pa.int64())], ["content", "n_tokens"])
            pa.default_memory_pool().release_unused()

    counted = materialize(one.select("content", "text").mapInArrow(count, "content string, n_tokens long"), "counted")
    known = materialize(stored.select("content", "n_tokens", F.lit(True).alias("cached")).join(rows.select("content").distinct(), "content", "left_semi"), "known")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = known.unionByName(counted.withColumn("cached", F.lit(False)))
    return rows.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")
