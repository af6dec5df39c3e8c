"""Benchmark decontamination: n-gram seeds find (document, item) candidates, Smith-Waterman
alignment of words scores them, so that edited and paraphrased copies are found as well.

Seeds are counted over all documents. Where a rare one stands, the item is aligned. Where a frequent
one stands, the words around it must first hold so many of the item's that the score can be reached:
an exact bound, so no pair is lost for the frequency of its seeds.

Test items are written to the shared folder in blocks of bounded size, which tasks read; documents
never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recjobs.functions.storage import materialize, parquet_batches
from recjobs.llm.chunks import ragged
from recjobs.llm.textvec import Texts, mix, slices, windows

_U = np.uint64
BLOCK_BYTES = 16 << 20  # of test items at a time
SEED_WORDS = 3
RARE = 100  # documents that hold a rare seed, at most
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5  # of the score of an unchanged copy
SIEVE_BITS = 24
ALIGN_CELLS = 1 << 21  # of one alignment step
HITS = 1 << 20  # pairs of a seed in a text and one in an item at a time


class Seeds:
    """Where the seeds of one length stand in the items."""

    def __init__(self, length: int, items: list[np.ndarray], which: list[int]):
        self.length = length
        runs = [windows(items[i], length) for i in which]
        seed = np.concatenate([np.empty(0, _U), *runs])
        sizes = [len(r) for r in runs]
        order = np.argsort(seed, kind="stable")
        self.item = np.repeat(np.array(which, np.int64), sizes)[order]
        self.at = (np.concatenate([np.empty(0, np.int64), *map(np.arange, sizes)]))[order].astype(np.int64)
        self.unique, self.start = np.unique(seed[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(seed)))
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(self.unique >> _U(64 - SIEVE_BITS)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of seeds among the words of texts, and which of ``unique`` each is."""
        runs = windows(words, self.length)
        where = np.flatnonzero(self.sieve[(runs >> _U(64 - SIEVE_BITS)).astype(np.int64)])
        where = where[doc[where] == doc[where + self.length - 1]]
        found = np.searchsorted(self.unique, runs[where])
        same = self.unique[np.minimum(found, len(self.unique) - 1)] == runs[where]
        return where[same], found[same]


class Block:
    """Items of the query set and their seed n-grams."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = sorted(rows)
        self.ids = np.array([r[0] for r in rows], np.int64)
        texts = Texts(pa.array([r[1] for r in rows], pa.string()), lower=True)
        starts, ends, first = texts.words()
        words = texts.hashes(starts, ends)
        self.items = [words[a:b] for a, b in zip(first[:-1], first[1:])]
        self.lengths = np.array([len(w) for w in self.items], np.int64)
        # an item of fewer words than a seed is one seed as a whole
        by_length = {n: np.flatnonzero(np.minimum(self.lengths, SEED_WORDS) == n).tolist() for n in range(1, SEED_WORDS + 1)}
        self.seeds = [Seeds(n, self.items, which) for n, which in by_length.items() if which]

    @staticmethod
    def read(files: list[str]) -> Block:
        return Block([r for batch in parquet_batches(files, 1 << 16) for r in zip(*(c.to_pylist() for c in batch.columns))])


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best local alignment scores of rows of items against rows of windows, and where in the
    window they end. Linear gaps: a row's left-to-right gaps are one running maximum."""
    n, width = window.shape
    slope = -GAP * np.arange(width + 1, dtype=np.int32)
    row = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for k in range(item.shape[1]):
        step = np.where(window == item[:, k : k + 1], np.int32(MATCH), np.int32(MISMATCH))
        new = np.zeros_like(row)
        np.maximum(row[:, :-1] + step, row[:, 1:] + GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        top = new.max(1)
        better = top > best
        end[better] = new[better].argmax(1)
        best = np.maximum(best, top)
        row = new
    return best, end


def may_align(items: np.ndarray, length: np.ndarray, window: np.ndarray, min_score: float) -> np.ndarray:
    """Which rows of items have so many words in their windows that the score can be reached: an
    alignment's score is at most MATCH for each word of the item that the window holds."""
    row = mix(np.arange(len(items), dtype=_U) + _U(1))[:, None]
    held = np.isin(items ^ row, window ^ row) & (np.arange(items.shape[1]) < length[:, None])
    return held.sum(1) / length >= min_score


def _hits(block: Block, words: np.ndarray, doc: np.ndarray, frequent: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """``(position, item, position less that in the item, of a frequent seed)`` of the items' seeds among
    the words of texts, about HITS at a time. A seed that several items hold counts for each."""
    for seeds, often in zip(block.seeds, frequent):
        at, seed = seeds.hits(words, doc)
        piece = np.cumsum(seeds.count[seed]) // HITS
        for a, b in zip(*(np.searchsorted(piece, np.unique(piece), side=side) for side in ("left", "right"))):
            times = seeds.count[seed[a:b]]
            entry = ragged(seeds.start[seed[a:b]], times)
            where = np.repeat(at[a:b], times)
            yield where, seeds.item[entry], where - seeds.at[entry], np.repeat(often[seed[a:b]], times)


def _align(texts: Texts, block: Block, frequent: list[np.ndarray], min_score: float) -> list[tuple[int, int, float, int]]:
    """``(text, item, score, last word)`` of the pairs that align well enough."""
    starts, ends, first = texts.words()
    words = texts.hashes(starts, ends)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for where, item, diagonal, often in _hits(block, words, doc, frequent):
        place, length = doc[where], block.lengths[item]
        # hits near one diagonal share a window, whose place doesn't depend on which of them are rare
        cell = diagonal // np.maximum(length // 2, 1)
        order = np.lexsort((diagonal, item, place))
        place, item, length, diagonal, cell, often = (x[order] for x in (place, item, length, diagonal, cell, often))
        new = np.ones(len(order), bool)
        new[1:] = (place[1:] != place[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1])
        often = np.logical_and.reduceat(often, np.flatnonzero(new))
        place, item, length, diagonal = (x[new] for x in (place, item, length, diagonal))
        by_length = np.argsort(length, kind="stable")
        a = 0
        while a < len(by_length):
            # so many rows that their windows hold ALIGN_CELLS words, one at least
            width = 2 * length[by_length[a : a + 512]] + 8
            n = max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), ALIGN_CELLS, side="right")))
            rows = by_length[a : a + n]
            a += n
            longest = int(length[rows].max())
            items = np.zeros((len(rows), longest), _U)
            for r, k in enumerate(item[rows]):
                items[r, : len(block.items[k])] = block.items[k]
            start = diagonal[rows] - longest // 2 - 4
            index = start[:, None] + np.arange(2 * longest + 8)
            ok = (index >= first[place[rows]][:, None]) & (index < first[place[rows] + 1][:, None])
            window = np.where(ok, words[np.clip(index, 0, len(words) - 1)], _U(1))
            go = ~often[rows]
            go[~go] = may_align(items[~go], length[rows][~go], window[~go], min_score)
            rows, start = rows[go], start[go]
            score, end = smith_waterman(items[go], window[go])
            share = score / (MATCH * length[rows])
            for r in np.flatnonzero(share >= min_score):
                key = int(place[rows[r]]), int(item[rows[r]])
                best[key] = max(best.get(key, (0.0, 0)), (float(share[r]), int(start[r] + end[r] - first[key[0]])))
    return [(d, i, s, e) for (d, i), (s, e) in best.items()]


def _blocks(items: DataFrame) -> Iterator[list[str]]:
    """The files of the items by blocks of about BLOCK_BYTES."""
    n_bytes = items.agg(F.sum(F.octet_length("text") + 8)).first()[0]
    n = 1 + (n_bytes or 0) // BLOCK_BYTES
    for k in range(n if n_bytes else 0):
        yield materialize(items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k), "test-items").inputFiles()


def frequent_seeds(source: DataFrame, files: list[str], rare: int) -> DataFrame:
    """The hashes ``seed`` of the block's seeds that more than ``rare`` documents hold. A task sends each
    seed that it finds once, with its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block.read(files)
        totals = [np.zeros(len(seeds.unique), np.int64) for seeds in block.seeds]
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column(part.schema.get_field_index("text")), lower=True)
                starts, ends, first = texts.words()
                words = texts.hashes(starts, ends)
                doc = np.repeat(np.arange(len(texts)), np.diff(first))
                for seeds, total in zip(block.seeds, totals):
                    at, seed = seeds.hits(words, doc)
                    total += np.bincount(np.unique(doc[at] * len(total) + seed) % max(len(total), 1), minlength=len(total))
        for seeds, total in zip(block.seeds, totals):
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seeds.unique[found].view(np.int64)), pa.array(total[found])], ["seed", "n"])

    return source.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).filter(F.col("n") > rare).select("seed")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``(doc_id, item_id, score, last_word)`` of each document and test item that align.

    Score is the alignment's share of an unchanged copy's score, 1 at most; last_word is where in the
    document the best alignment ends. Null, empty and blank texts and items are in no pair; an item of
    fewer than SEED_WORDS words is found where all of it stands. Repeated documents give repeated rows; an
    item id that repeats stands for several items. Other columns are ignored; empty tables give no rows.
    RARE and the size of blocks change the cost alone.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter("item_id is not null and text is not null")
    schema, found = "doc_id long, item_id long, score double, last_word long", None
    for files in _blocks(items):
        often = materialize(frequent_seeds(source, files, RARE), "frequent-seeds").inputFiles()

        def align(batches: Iterator[pa.RecordBatch], files: list[str] = files, often: list[str] = often) -> Iterator[pa.RecordBatch]:
            block = Block.read(files)
            hashes = np.concatenate([np.empty(0, _U), *(b.column(0).to_numpy().view(_U) for b in parquet_batches(often, 1 << 16))])
            frequent = [np.isin(seeds.unique, hashes) for seeds in block.seeds]
            for batch in batches:
                for part in slices(batch):
                    pairs = _align(Texts(part.column(1), lower=True), block, frequent, min_score)
                    if pairs:
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([p[0] for p in pairs])), pa.array(block.ids[[p[1] for p in pairs]]), pa.array([p[2] for p in pairs]), pa.array([p[3] for p in pairs], pa.int64())], ["doc_id", "item_id", "score", "last_word"])

        one = source.mapInArrow(align, schema)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], schema) if found is None else found
