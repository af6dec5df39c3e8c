"""A cleaning pipeline over ``documents``: each stage reads what the one before it wrote.

All stages but the last return the columns of their ``docs``, whatever these are called beside doc_id,
text and n_chars. An empty table gives an empty table. Rows that repeat (an id, or all of a row) are
rows of their own except where a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from recjobs.functions.storage import materialize
from recjobs.functions.workers import small_batches
from recjobs.llm.decontaminate import find_contamination
from recjobs.llm.language import identify_language
from recjobs.llm.line_dedup import line_dedup
from recjobs.llm.ngram_join import ngram_jaccard_join
from recjobs.llm.pieces import encode_pieces
from recjobs.llm.queries import tokenizer_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(step: Stage) -> Stage:
    """Stages run in one session, whose executors keep their workers: all of them pass small Arrow batches."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return step(spark, docs, sf_dir)

    return run


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no letter go (null and empty texts among them), each for itself. The predicted
    language has no say in what is kept, as every learned language is clean text here."""
    found = identify_language(docs, with_row=True).filter("lang_pred <> 'und'")
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks go from the later document, and a document with nothing else goes altogether.

    Null and empty texts stay as they are, as do rows without an id; rows of one id never delete from
    each other, and of equal texts that of the least id stays. n_chars follows the text."""
    found = line_dedup(docs, with_row=True)
    found = found.filter((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_deleted") == 0, F.col("row")["n_chars"]).otherwise(F.char_length("text").cast("long"))
    changed = {"text": F.col("text"), "n_chars": n_chars}
    return found.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at 0.8, the one of least id stays.

    Rows that repeat an id are one document and stay or go together. Texts without a word, and rows
    without an id, are linked with nothing and stay."""
    groups = ngram_jaccard_join(docs, k=5, threshold=0.8)
    return docs.join(groups.filter("component_id < doc_id").select("doc_id"), "doc_id", "left_anti")


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, or an edited copy of one, go, with all rows of their id. Null and
    empty texts hold none; without test items all stay."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id"), "doc_id", "left_anti")


@stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, starts, ends)`` of each row: piece ids with their byte spans. Null and empty texts
    have the end id alone."""
    return encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
ORACLE_SQL = None  # models, components and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = materialize(step(spark, docs, sf_dir), name)
    return docs
