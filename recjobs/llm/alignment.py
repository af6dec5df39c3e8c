"""Alignment of the tokens of two tokenizers over the same bytes, and counts of linked token pairs.

Tokens of A (byte-level BPE, over a blank and the text) and of B (sentencepiece, which adds the blank)
are the two sides of a graph; an edge joins tokens whose byte ranges overlap. Union-find over the edges
gives the connected components, which are the least groups that both tokenizers cut alike.

Texts are aligned by blocks of bounded bytes. A block is written with the table of its distinct pairs;
documents refer to that table, so only distinct pairs of a block are shuffled to be counted over the
corpus, and their counts travel back to the block, not to each document.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from recjobs.functions.storage import materialize
from recjobs.llm.chunks import ChunkIds, counts_of, flat
from recjobs.llm.pieces import BLANK, piece_encoder
from recjobs.llm.textvec import Texts, slices

BLOCK_BYTES = 4 << 20  # of text that one block holds, unless a single text is longer
SLICE_BYTES = 1 << 19  # of text aligned at a time
B_BITS = 24  # of a pair's number that hold the id of B
PER_DOC = "n_a", "n_b", "n_groups", "n_links"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters
    stand for themselves, the other bytes have those from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def after_blank(data: np.ndarray) -> np.ndarray:
    """Where the byte before may be part of a blank character of more than one byte."""
    out = np.zeros(len(data), bool)
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        out[2:] |= (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
        out[2:] |= (a >= 0xE1) & (a <= 0xE3) & ((b == 0x80) | (b == 0x81) | (b == 0x9A))
    if len(data) > 1:
        out[1] |= data[0] == 0xC2
    return out


class ByteLevelEncoder:
    """Ids of a byte-level BPE tokenizer; names of special tokens in a text are plain text.

    The split before the merges never joins a word to the blanks after it, so texts are cut where
    blanks begin, and each distinct stretch goes to the library once while it is remembered. A
    tokenizer with another split, or a normaliser, gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.by_stretch = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        letters = byte_letters()
        names = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            names[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes = pa.array(names, pa.large_binary())
        self.stretches = ChunkIds(self._learn)

    def _learn(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = (stretches[k : k + 10_000] for k in range(0, len(stretches), 10_000))
        return flat([e.ids for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts ``data[offsets[i]:offsets[i + 1]]`` one after the other, and their counts."""
        start = np.zeros(len(data) + 1, bool)
        start[offsets] = True
        if self.by_stretch:
            blank = (data == 32) | (data >= 9) & (data <= 13)
            start[1:-1] |= blank[1:] & ~blank[:-1] & ~after_blank(data)[:-1] & (data[:-1] > 31)
        at = np.flatnonzero(start)
        cut = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))) if len(data) else pa.array([], pa.large_string())
        numbered = cut.dictionary_encode()
        ids, n = self.stretches.gather(numbered.dictionary.to_pylist(), numbered.indices.to_numpy())
        return ids, counts_of(n, np.searchsorted(at, offsets))


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component, given edges u-v: roots hang on smaller roots that they
    meet, and paths are halved until each node hangs on its root."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up


class Aligner:
    """Both tokenizers of a Python worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevelEncoder(a_path), piece_encoder(b_path)
        model = self.b.model
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)], pa.large_binary())
        n_a, n_b = len(self.a.bytes), len(pieces)
        self.n_a, self.n_b = n_a, n_b
        self.names = pa.array([f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)], pa.large_string())

    def align(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        """Of each text the counts PER_DOC, its groups as text (``told``: bytes), and all links one
        after the other as ids (``link_a``, ``link_b``)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        plain = Texts(texts)
        some = plain.offsets[:-1] < plain.offsets[1:]
        data = np.insert(plain.bytes, plain.offsets[:-1][some], 32)
        offsets = plain.offsets + np.concatenate([[0], np.cumsum(some)])
        a_ids, a_n = self.a.encode(data, offsets)
        b_ids, b_n = self.b.encode(self.b.normalize(texts)[0])
        b_ids, b_n = np.delete(b_ids, np.cumsum(b_n) - 1), b_n - 1  # without the end id
        a_first, b_first = (np.concatenate([[0], np.cumsum(n)]) for n in (a_n, b_n))
        a_joined, b_joined = self.a.bytes.take(pa.array(a_ids)), self.b_bytes.take(pa.array(b_ids))
        a_ends, b_ends = (np.frombuffer(x.buffers()[1], np.int64)[: len(x) + 1] if len(x) else np.zeros(1, np.int64) for x in (a_joined, b_joined))
        own = memoryview(np.ascontiguousarray(data)).cast("B")
        held = [(memoryview(x.buffers()[2]).cast("B") if len(x) else memoryview(b""), ends[first].tolist()) for x, ends, first in ((a_joined, a_ends, a_first), (b_joined, b_ends, b_first))]
        at = offsets.tolist()
        same = np.array([all(joined[ends[i] : ends[i + 1]] == own[at[i] : at[i + 1]] for joined, ends in held) for i in range(len(texts))], bool)
        if not same.all():
            return self.align(pa.array([t if ok else "" for t, ok in zip(texts.to_pylist(), same.tolist())], pa.large_string()))

        # each stretch between ends of either side lies in one token of A and one of B: an overlap
        is_a, is_b = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        is_a[a_ends[1:]] = is_b[b_ends[1:]] = True
        ends = np.flatnonzero(is_a | is_b)
        i, j = (np.cumsum(x[ends]) - x[ends] for x in (is_a, is_b))
        na, nb = len(a_ids), len(b_ids)
        group = union_find(na + nb, i, na + j)
        of_a, of_b = group[:na], group[na:]
        tops = np.flatnonzero(of_a == np.arange(na))

        # members of each group in turn: those of A, then those of B
        told = np.empty(na + nb, np.int64)
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (of_a, of_b))
        told[np.arange(na) + np.searchsorted(of_b, of_a, "left")] = a_ids + self.n_a * last_a
        told[np.arange(nb) + np.searchsorted(of_a, of_b, "right")] = b_ids + 2 * self.n_a + self.n_b * last_b
        names = self.names.take(pa.array(told))
        cut = np.frombuffer(names.buffers()[1], np.int64)[a_first + b_first].tolist() if len(names) else [0] * (len(texts) + 1)
        text = memoryview(names.buffers()[2]) if len(names) else memoryview(b"")
        return {
            "n_a": a_n, "n_b": b_n, "n_groups": np.diff(np.searchsorted(tops, a_first)), "n_links": np.diff(np.searchsorted(ends, offsets, "right")),
            "told": [text[x : max(x, y - 1)] for x, y in zip(cut[:-1], cut[1:])],
            "link_a": a_ids[i].astype(np.int64), "link_b": b_ids[j].astype(np.int64),
        }


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One a Python worker: the tasks that a worker runs in turn share what is remembered."""
    return Aligner(a_path, b_path)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def aligned_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups)``; groups read ``a1,a2|b1;a3|b2,b3``, ids of A and
    of B in order. Texts without tokens (null, empty, or not the bytes of both sides) have zeros and ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                found = aligner(a_path, b_path).align(part.column(1))
                told = pa.array([bytes(x).decode() for x in found["told"]], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[c], pa.int64()) for c in PER_DOC), told], ["doc_id", *PER_DOC, "groups"])

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string")


_BLOCK = (
    "block long, pairs array<long>, n_docs array<int>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, digest array<string>, n_pairs array<int>, links binary"
)


def _pairs_by_doc(n_links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each document in turn, how often each is linked, and how many there are."""
    doc = np.repeat(np.arange(len(n_links)), n_links)
    pair = a << B_BITS | b
    order = np.lexsort((pair, doc))
    pair, doc = pair[order], doc[order]
    new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1]))[: len(pair)])
    return pair[new], np.diff(np.append(new, len(pair))), np.bincount(doc[new], minlength=len(n_links))


def align_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row a block of documents: the block's distinct pairs with the number of its documents
    that hold each, and per document its counts, the digest of its groups, and its pairs (``links``:
    places in ``pairs`` and how often each is linked, compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, pack = aligner(a_path, b_path), 0, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for block in slices(batch, size=BLOCK_BYTES):
                per_doc: dict[str, list] = {c: [] for c in PER_DOC}
                digests, pairs, times, sizes = [], [], [], []
                for part in slices(block, size=SLICE_BYTES):
                    found = own.align(part.column(1))
                    for c in PER_DOC:
                        per_doc[c].append(found[c])
                    digests += [hashlib.sha256(x).hexdigest() if len(x) else "" for x in found["told"]]
                    for held, x in zip((pairs, times, sizes), _pairs_by_doc(found["n_links"], found["link_a"], found["link_b"])):
                        held.append(x)
                table, code, n_docs = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
                links = pack(np.stack([code, np.concatenate(times)]).astype("<i4").tobytes())
                whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                row = [pa.array([TaskContext.get().partitionId() << 32 | n], pa.int64()), whole(table, pa.int64()), whole(n_docs.astype(np.int32), pa.int32()), whole(block.column(0), pa.int64())]
                row += [whole(np.concatenate(per_doc[c]), pa.int64()) for c in PER_DOC]
                row += [whole(digests, pa.string()), whole(np.concatenate(sizes).astype(np.int32), pa.int32()), pa.array([links], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, [c.split()[0] for c in _BLOCK.split(", ")])
                n += 1
            pa.default_memory_pool().release_unused()

    return materialize(_source(docs, id_col, text_col).mapInArrow(run, _BLOCK), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, n_docs, best)``: the documents that hold a pair linked, corpus-wide, and whether no other
    pair of its id of A is held by more."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n_docs").alias("n_docs"))
    pairs = materialize(pairs.withColumn("a", F.shiftright("pair", B_BITS)), "pairs")
    most = pairs.groupBy("a").agg(F.max("n_docs").alias("most"))
    return pairs.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            rated = row["rated"].values
            n_docs, best = (rated.field(c).to_numpy(zero_copy_only=False) for c in ("n_docs", "best")) if rated is not None else (np.empty(0, np.int64), np.empty(0, bool))
            code, times = np.frombuffer(unpack(row["links"].as_py()), "<i4").reshape(2, -1)
            first = np.concatenate([[0], np.cumsum(row["n_pairs"].values.to_numpy())])
            sums = (np.concatenate([[0], np.cumsum(times.astype(np.int64) * x[code])]) for x in (best, n_docs))
            n_best, count_sum = (pa.array(s[first[1:]] - s[first[:-1]], pa.int64()) for s in sums)
            yield pa.RecordBatch.from_arrays([row["doc_id"].values, *(row[c].values for c in PER_DOC), n_best, count_sum, row["digest"].values], ["doc_id", *PER_DOC, "n_best", "count_sum", "groups_sha256"])


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of each row.

    A pair's count is the number of rows that hold it linked; n_best are a row's links whose count is
    the highest of their id of A, count_sum adds the counts of all its links. Null and empty texts, and
    texts that either tokenizer doesn't give back byte by byte (with U+2581, say), have zeros and ''.
    Rows that repeat an id, or without one, are rows of their own; other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    blocks = align_blocks(docs, a_path, b_path, id_col, text_col)
    entries = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    met = entries.join(pair_counts(blocks), "pair")
    # as many entries as the block has distinct pairs
    rated = met.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "n_docs", "best"))).alias("rated"))
    both = blocks.drop("pairs", "n_docs").join(rated, "block", "left")
    return both.mapInArrow(_rated, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
