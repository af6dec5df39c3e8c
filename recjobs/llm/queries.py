"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recjobs.functions.storage import new_folder
from recjobs.llm import ngram_join, quality, warc
from recjobs.llm.alignment import align_tokenizers
from recjobs.llm.decontaminate import find_contamination
from recjobs.llm.importance import importance_resampling
from recjobs.llm.language import identify_language
from recjobs.llm.line_dedup import line_dedup
from recjobs.llm.ngram_join import ngram_jaccard_join
from recjobs.llm.pieces import piece_digests
from recjobs.llm.sharding import shard_by_slots
from recjobs.llm.token_counts import token_counts
from recjobs.llm.token_planes import token_planes
from recjobs.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Vocabulary files of public tokenizers, where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _id_remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(n))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), k=3, threshold=Fraction(9, 10))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=_id_remainder(5) != 0)
    return scored.select("doc_id", (_id_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_cascade(_table(spark, sf_dir, "documents"))


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_slots(_table(spark, sf_dir, "documents"), shards=40)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_language(_table(spark, sf_dir, "documents"), learn=_id_remainder(3) != 1)
    return found.select("doc_id", (_id_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first."""
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), new_folder(spark, "token-counts"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard, op2_toxicity, op3_line_dedup, op4_warc, op5_decontamination, op6_quality_cascade, op7_token_planes, op8_sentencepiece, op9_sharding, op10_language_id,
        op11_alignment, op12_token_counts, op13_importance,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard": ngram_join.SQL, "op4_warc": warc.SQL, "op6_quality_cascade": quality.SQL}
