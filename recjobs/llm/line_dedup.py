"""Line deduplication by pairwise alignment.

Documents that share a key are aligned by patience diff; the common blocks are deleted from the later one
(larger id). A single line may stand in any number of documents, so keys are the shortest runs of lines
that hold BLOCK_CHARS characters, from each line on and up to each line: a common block that is long
enough to go is a union of such runs. Of the documents that hold a key only the first one is a partner,
as it has the whole run; so a key of n documents makes n - 1 pairs.

Rare keys, of RARE documents at most, are taken first. Those that more documents hold find partners only
for documents in which a run of theirs is still there after that, which brings the rest. Blocks that stand in
another order than in the partner are met by aligning what is left again, and an exact check of the
pair's runs follows. So a line goes if, and only if, it lies in a block of consecutive lines, of
BLOCK_CHARS characters or more, that an earlier document holds, too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from recjobs.functions.storage import materialize
from recjobs.llm.components import hot_limit, split_join
from recjobs.llm.textvec import run_hashes

BLOCK_CHARS = 40  # a common block of fewer characters stays
RARE = 16  # documents that hold a rare key, at most
SPREAD = 64  # a document that is the partner of many is met in so many groups


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of two sequences, increasing in both: lines unique in both are anchors (their
    longest increasing run), between which the same is done again; equal ends are matched first."""
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: j for j, x in enumerate(b[b0:b1], b0) if once_b[x] == 1}
        pairs = [(i, at[x]) for i, x in enumerate(a[a0:a1], a0) if once_a[x] == 1 and x in at]
        tops: list[int] = []
        tail: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(pairs):
            p = bisect_left(tops, j)
            back.append(tail[p - 1] if p else -1)
            tops[p : p + 1], tail[p : p + 1] = [j], [k]
        chain, k = [], tail[-1] if tail else -1
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        if chain:
            last = a0, b0
            for i, j in [*reversed(chain), (a1, b1)]:
                stack.append((last[0], i, last[1], j))
                if i < a1:
                    out.append((i, j))
                last = i + 1, j + 1
    return sorted(out)


def common_blocks(later: list[int], earlier: list[int], chars: list[int]) -> list[int]:
    """Positions of the later sequence in aligned blocks of BLOCK_CHARS characters or more."""
    out, block, before = [], [], None
    for i, j in [*patience(later, earlier), (-1, -1)]:
        if before is not None and (i, j) != (before[0] + 1, before[1] + 1):
            if sum(chars[p] for p in block) >= BLOCK_CHARS:
                out += block
            block = []
        block.append(i)
        before = i, j
    return out


def key_runs(chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, end)`` of the shortest runs of BLOCK_CHARS characters from each line on and up to
    each line. Text i has the lines from ``first[i]`` to ``first[i + 1]``."""
    text, at = np.repeat(np.arange(len(first) - 1), np.diff(first)), np.arange(len(chars))
    total = np.concatenate([[0], np.cumsum(chars)])
    end = np.searchsorted(total, total[:-1] + BLOCK_CHARS, side="left")
    start = np.searchsorted(total, total[1:] - BLOCK_CHARS, side="right") - 1
    on, up = end <= first[text + 1], start >= first[text]
    return np.concatenate([text[on], text[up]]), np.concatenate([at[on], start[up]]), np.concatenate([end[on], at[up] + 1])


def block_keys(lines: np.ndarray, chars: np.ndarray, first: np.ndarray, gone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(text, key)`` of the key runs, each once a text; ``lines`` are hashes. Runs of which no line is
    left (``gone`` marks lines) are no keys."""
    text, start, end = key_runs(chars, first)
    if gone is not None:
        before = np.concatenate([[0], np.cumsum(gone)])
        left = before[end] - before[start] < end - start
        text, start, end = text[left], start[left], end[left]
    key = run_hashes(lines.view(np.uint64), start, end).view(np.int64)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    return text[new], key[new]


def shared_lines(later: list[int], earlier: list[int], chars: list[int]) -> list[int]:
    """Positions of the later sequence in blocks of BLOCK_CHARS characters or more that the earlier one has.

    What an alignment leaves is aligned again, stretch by stretch, as blocks may be moved; then runs that
    no alignment finds (lines that repeat are no anchors) are looked up."""
    gone, stack, known = set(), [(0, len(later))], set(earlier)
    while stack:
        a, b = stack.pop()
        some = sum(c for x, c in zip(later[a:b], chars[a:b]) if x in known) >= BLOCK_CHARS
        found = [a + p for p in common_blocks(later[a:b], earlier, chars[a:b])] if some else []
        gone.update(found)
        ends = [a - 1, *found, b] if found else []
        stack += [(x + 1, y) for x, y in zip(ends[:-1], ends[1:]) if y > x + 1]
    if len(gone) < len(later):
        own = [np.array(x, np.int64).view(np.uint64) for x in (later, earlier)]
        here = np.array(chars, np.int64)
        length = dict(zip(later, chars))
        there = np.array([length.get(x, BLOCK_CHARS) for x in earlier], np.int64)  # lines of the later one alone matter
        runs = [key_runs(c, np.array([0, len(c)])) for c in (here, there)]
        keys = [run_hashes(x, start, end) for x, (_, start, end) in zip(own, runs)]
        for k in np.flatnonzero(np.isin(keys[0], keys[1])).tolist():
            gone.update(range(runs[0][1][k], runs[0][2][k]))
    return sorted(gone)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of rows ``(doc_id, mark, hashes, chars)``; a fifth column has the lines that are gone."""
    for batch in batches:
        hashes, chars = batch.column(2), batch.column(3)
        first = hashes.offsets.to_numpy().astype(np.int64)
        gone, first = None, first - first[0]
        if batch.num_columns > 4:
            gone, places = np.zeros(first[-1], bool), batch.column(4)
            gone[places.flatten().to_numpy() + np.repeat(first[:-1], np.diff(places.offsets.to_numpy()))] = True
        text, key = block_keys(hashes.flatten().to_numpy(), chars.flatten().to_numpy().astype(np.int64), first, gone)
        yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text))], ["key", "doc_id", "mark"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        later, chars, earlier = (batch.column(k).to_pylist() for k in range(2, 5))
        gone = [shared_lines(a, b, c) for a, b, c in zip(later, earlier, chars)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "mark", "gone"])


def _deleted(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """``(doc_id, mark, deleted)`` after aligning pairs ``(doc_id, mark, first_id, first_mark)``."""
    pairs = materialize(pairs.distinct().withColumn("spread", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))), "pairs")
    # a partner of many documents goes to each group of them once
    needed = pairs.select("first_id", "first_mark", "spread").distinct()
    first = needed.join(held.select(F.col("doc_id").alias("first_id"), F.col("mark").alias("first_mark"), F.col("hashes").alias("before")).hint("merge"), ["first_id", "first_mark"])
    both = pairs.join(held.hint("merge"), ["doc_id", "mark"]).join(first.hint("merge"), ["first_id", "first_mark", "spread"])
    aligned = both.select("doc_id", "mark", "hashes", "chars", "before").mapInArrow(_align, "doc_id long, mark long, gone array<int>")
    gone = aligned.select("doc_id", "mark", F.explode("gone").alias("line")).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("line")).alias("deleted"))
    return materialize(gone, "gone")


@F.pandas_udf(StringType())
def _without(text: pd.Series, deleted: pd.Series) -> pd.Series:
    def cut(t: str | None, gone: np.ndarray) -> str | None:
        if t is None:
            return None
        lines, drop = t.split("\n"), set(gone.tolist())
        return "\n".join([x for i, x in enumerate(lines) if i not in drop])

    return pd.Series([cut(t, gone) for t, gone in zip(text, deleted)], dtype=object)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """``(doc_id, text, n_lines, n_deleted, deleted)``: the text without the lines deleted, how many
    lines there were and went, and their positions (from 0); ``with_row`` adds the whole row as a struct.

    A line goes if it lies in a block of consecutive lines, of BLOCK_CHARS characters or more, that a
    document of smaller id holds, too. Lines are compared without blanks around them, by 64-bit hashes. A null text stays null with no
    lines; an empty one has one empty line. Rows of one id never delete from each other: each is
    aligned with rows of smaller ids for itself, and rows that repeat an id and a text get the same
    result. Of equal documents the one of least id keeps its lines. Rows without an id are kept as they
    are. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    text = F.col(text_col)
    lines = F.split(text, "\n")
    source = docs.filter(F.col(id_col).isNotNull() & text.isNotNull())
    # the same id may stand for several texts, so a row is known by both
    mark = F.xxhash64(text)
    held = source.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("mark"), F.transform(lines, lambda x: F.xxhash64(F.trim(x))).alias("hashes"), F.transform(lines, lambda x: F.char_length(F.trim(x))).alias("chars"))
    held = materialize(held, "lines")

    schema = "key long, doc_id long, mark long"
    keys = materialize(held.mapInArrow(_keys, schema), "keys")
    owner = keys.groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("n_rows")).filter("n_rows > 1")
    owner = materialize(owner.select("key", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"), "n_rows"), "owners")
    partners = lambda found: found.filter("doc_id > first_id").select("doc_id", "mark", "first_id", "first_mark")
    rare = _deleted(partners(keys.join(owner.filter(F.col("n_rows") <= RARE).drop("n_rows"), "key")), held)

    left = held.join(rare.hint("merge"), ["doc_id", "mark"], "left").select("doc_id", "mark", "hashes", "chars", F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"))
    still = left.mapInArrow(_keys, schema)
    rest = _deleted(partners(split_join(still, owner.filter(F.col("n_rows") > RARE), ["key"], hot_limit(keys.count()))), held)
    both = rare.unionByName(rest).groupBy("doc_id", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("deleted")))).alias("deleted"))  # two rows at most
    gone = materialize(both, "gone")

    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("mark"), F.struct(*docs.columns if with_row else [text_col]).alias("row"))
    # a sort-merge join at every size: the documents that change grow with the corpus
    result = row.join(gone.hint("merge"), ["doc_id", "mark"], "left").withColumn("deleted", F.coalesce("deleted", F.array().cast("array<int>")))
    text = F.col("row")[text_col]
    changed = F.size("deleted") > 0
    kept = F.when(changed, _without(F.when(changed, text), F.col("deleted"))).otherwise(text)
    return result.select("doc_id", kept.alias("text"), F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).alias("n_lines"), F.size("deleted").alias("n_deleted"), "deleted", *(["row"] if with_row else []))
