"""Quality rules as a short-circuit cascade.

Word, symbol and repetition counts are returned for every document. The further rules only see the
documents that no earlier rule rejected; their order is chosen by rejection per cost, both measured
on a bounded sample. A document is kept if no rule rejects it, so the order changes the cost alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from recjobs.llm.textvec import SPACE, Texts, mix, slices, windows

_U = np.uint64
SAMPLE_ROWS = 2000  # documents on which rules are timed, whatever the size of the table
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOLS = _table("#*$%&|<>")
UPPER, LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
EXCLAMATION, DIGITS = _table("!"), _table("0123456789")


def _count(texts: Texts, mask: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return np.diff(sums[texts.offsets])


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal keys: which are not the first, and which have an equal."""
    order = np.argsort(keys, kind="stable")
    equal = np.zeros(len(keys) + 1, bool)
    equal[1:-1] = keys[order][1:] == keys[order][:-1]
    later, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = equal[:-1]
    shared[order] = equal[:-1] | equal[1:]
    return later, shared


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS, and n_lines (lines with a word), of each text."""
    texts = Texts(column)
    n = len(texts)
    starts, ends, first = texts.words()
    n_words = np.diff(first)
    characters = _count(texts, ((texts.bytes & 0xC0) != 0x80) & ~SPACE[texts.bytes])

    line_starts, line_ends, first_line = texts.ranges(texts.bytes != 10)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_doc = np.repeat(np.arange(n), np.diff(first_line))[has_word]
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    later, _ = _repeated(texts.hashes(line_starts, line_ends) ^ mix(line_doc.astype(_U) + _U(1)))

    runs = windows(texts.hashes(starts, ends), WINDOW)
    word_doc = np.repeat(np.arange(n), n_words)
    at = np.flatnonzero(word_doc[: len(runs)] == word_doc[WINDOW - 1 :]) if len(runs) else np.empty(0, np.int64)
    _, shared = _repeated(runs[at] ^ mix(word_doc[at].astype(_U) + _U(1)))
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[shared], 1)
    np.add.at(cover, at[shared] + WINDOW, -1)
    return {
        "n_words": n_words,
        "word_chars": characters,
        "n_symbols": _count(texts, SYMBOLS[texts.bytes]),
        "n_dup_lines": np.bincount(line_doc[later], minlength=n),
        "n_repeat_words": np.bincount(word_doc[np.cumsum(cover[:-1]) > 0], minlength=n),
        "n_lines": np.bincount(line_doc, minlength=n),
    }


def _many_symbols(column: pa.Array, c: dict) -> np.ndarray:
    return 4 * c["n_symbols"] > c["n_words"]


def _repeated_lines(column: pa.Array, c: dict) -> np.ndarray:
    return 2 * c["n_dup_lines"] > c["n_lines"]


def _word_length(column: pa.Array, c: dict) -> np.ndarray:
    return (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"])


def _upper_case(column: pa.Array, c: dict) -> np.ndarray:
    texts = Texts(column)
    return _count(texts, UPPER[texts.bytes]) > _count(texts, LOWER[texts.bytes])


def _exclamations(column: pa.Array, c: dict) -> np.ndarray:
    texts = Texts(column)
    return 2 * _count(texts, EXCLAMATION[texts.bytes]) > c["n_words"]


def _digits(column: pa.Array, c: dict) -> np.ndarray:
    texts = Texts(column)
    return 2 * _count(texts, DIGITS[texts.bytes]) > c["word_chars"]


#: Each rule rejects rows, given the texts and their base counts.
RULES: dict[str, Callable[[pa.Array, dict], np.ndarray]] = {
    "many_symbols": _many_symbols,
    "repeated_lines": _repeated_lines,
    "word_length": _word_length,
    "upper_case": _upper_case,
    "exclamations": _exclamations,
    "digits": _digits,
}


def rule_order(docs: DataFrame, id_col: str, text_col: str) -> list[tuple[str, float, float]]:
    """``(rule, seconds a document, rejected share)`` on a sample, best rejection per cost first."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, n = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
        for batch in batches:
            for part in slices(batch):
                column = part.column(0)
                counts = base_counts(column)
                n += len(column)
                for name, rule in RULES.items():
                    began = time.perf_counter()
                    rejected[name] += int(rule(column, counts).sum())
                    spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(RULES), "spent": list(spent.values()), "rejected": list(rejected.values()), "n": [n] * len(RULES)})

    total = max(docs.count(), 1)
    share = min(1.0, SAMPLE_ROWS / total)
    sample = docs.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(text_col).alias("text"))
    rows = sample.mapInArrow(measure, "rule string, spent double, rejected long, n long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()
    found = [(r.rule, r.spent / max(r.n, 1), r.rejected / max(r.n, 1)) for r in rows]
    missing = [(name, 0.0, 0.0) for name in RULES if name not in {f[0] for f in found}]
    return sorted(found + missing, key=lambda f: (-f[2] / max(f[1], 1e-9), f[0]))


def quality_cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)``.

    A null text counts as empty: all counts 0, base_failed, not kept. Equal rows give equal results;
    null ids are kept as null. Other columns are ignored, and an empty table gives no rows.
    """
    order = [name for name, _, _ in rule_order(docs, id_col, text_col)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                column = part.column(1)
                c = base_counts(column)
                failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])
                alive = np.flatnonzero(~failed)
                for name in order:
                    if not len(alive):
                        break
                    rejected = RULES[name](column.take(pa.array(alive)), {k: v[alive] for k, v in c.items()})
                    alive = alive[~rejected]
                kept = np.zeros(len(failed), bool)
                kept[alive] = True
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c[k], pa.int64()) for k in COUNTS), pa.array(failed), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "kept"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(judge, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS u
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n - l.u, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(l.n, 0) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS lower,
    length(regexp_replace(text, '[^!]', '', 'g')) AS exclamations, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits
  FROM w LEFT JOIN repeats r USING (doc_id) LEFT JOIN lines l USING (doc_id)
), base AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR upper > lower
    OR 2 * exclamations > n_words OR 2 * digits > word_chars) AS kept
FROM base
"""
