"""Token ids in binary files: blocks of ids, transposed into planes, each compressed with zstandard.

Layout: MAGIC, the blocks' planes, the zstandard-compressed document table (doc_id and n_tokens as
little-endian 64-bit integers), the block index (one BLOCK record each), the FOOTER.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from recjobs.functions.storage import materialize, new_folder
from recjobs.llm.chunks import ChunkIds, counts_of, flat
from recjobs.llm.files import create, open_file
from recjobs.llm.textvec import LOWER, Texts, slices

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
SLICE_BYTES = 4 << 20  # of text at a time
CACHE_BYTES = 96 << 20  # of chunks and their ids that a worker remembers
FOOTER = struct.Struct("<QQQQB7x8s")  # document table's place and length, index's place, number of blocks, bits a plane


def block_type(planes: int) -> np.dtype:
    """An entry of the block index."""
    return np.dtype([("offset", "<u8"), ("n_ids", "<u4"), ("lengths", "<u4", (planes,))])


def to_planes(ids: np.ndarray, bits: int) -> np.ndarray:
    """Rows of bytes: plane k holds byte k (bits = 8) or bit k (bits = 1) of each id."""
    by_byte = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if bits == 8:
        return np.ascontiguousarray(by_byte)
    return np.packbits(np.unpackbits(by_byte[:, :, None], axis=2, bitorder="little").transpose(0, 2, 1).reshape(32, -1), axis=1)


def from_planes(planes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The ids that ``to_planes`` laid out."""
    if bits == 8:
        return np.ascontiguousarray(planes.T).view("<u4").ravel()
    by_bit = np.unpackbits(planes, axis=1, count=n).reshape(4, 8, n)
    return np.ascontiguousarray(np.packbits(by_bit, axis=1, bitorder="little").reshape(4, n).T).view("<u4").ravel()


class PlaneWriter:
    def __init__(self, out, bits: int = 8, level: int = 3):
        self.out, self.bits, self.at = out, bits, 0
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.index: list[np.ndarray] = []
        self.held, self.n_held, self.docs, self.n_docs, self.n_ids = [], 0, [], 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents in turn: each has ``counts`` of ``ids``."""
        self.docs.append(np.stack([doc_ids, counts], 1).astype("<i8"))
        self.n_docs += len(doc_ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.empty(0, "<u4"), *self.held])
        stop = len(ids) if last else len(ids) - len(ids) % BLOCK_IDS
        for a in range(0, stop, BLOCK_IDS):
            block = ids[a : a + BLOCK_IDS]
            entry = np.zeros(1, block_type(32 // self.bits))
            entry["offset"], entry["n_ids"] = self.at, len(block)
            for k, plane in enumerate(to_planes(block, self.bits)):
                packed = self.pack(plane.tobytes())
                entry["lengths"][0, k] = len(packed)
                self._put(packed)
            self.index.append(entry)
        self.n_ids += stop
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        table = self.pack(np.concatenate([np.empty((0, 2), "<i8"), *self.docs]).tobytes())
        table_at = self.at
        self._put(table)
        index_at = self.at
        self._put(b"".join(e.tobytes() for e in self.index))
        self._put(FOOTER.pack(table_at, len(table), index_at, len(self.index), self.bits, MAGIC))
        self.out.close()


class PlaneReader:
    """Random access by block; ``documents`` goes through the file block by block."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        table_at, table_length, index_at, blocks, self.bits, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token planes")
        kind = block_type(32 // self.bits)
        self.index = np.frombuffer(source.read_at(blocks * kind.itemsize, index_at), kind)
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.docs = np.frombuffer(self.unpack(source.read_at(table_length, table_at)), "<i8").reshape(-1, 2)

    def block(self, k: int) -> np.ndarray:
        entry = self.index[k]
        data = self.source.read_at(int(entry["lengths"].sum()), int(entry["offset"]))
        ends = np.cumsum([0, *entry["lengths"].tolist()])
        planes = np.stack([np.frombuffer(self.unpack(data[a:b]), np.uint8) for a, b in zip(ends[:-1], ends[1:])])
        return from_planes(planes, int(entry["n_ids"]), self.bits)

    def documents(self) -> Iterator[tuple[int, int, Iterator[bytes]]]:
        """``(doc_id, n_tokens, pieces of its id bytes)`` in order; pieces must be used up in turn."""
        state = {"k": 0, "ids": np.empty(0, "<u4"), "at": 0}

        def pieces(n: int) -> Iterator[bytes]:
            while n:
                if state["at"] == len(state["ids"]):
                    state.update(ids=self.block(state["k"]), k=state["k"] + 1, at=0)
                part = state["ids"][state["at"] : state["at"] + n]
                state["at"] += len(part)
                n -= len(part)
                yield part.tobytes()

        for doc_id, n in self.docs.tolist():
            yield doc_id, n, pieces(n)


#: Bytes by how pre-tokens end: blanks (0), a-z (1), ASCII digits and marks but the apostrophe (2), all others (3)
_KIND = np.full(256, 3, np.uint8)
_KIND[33:127] = 2
_KIND[97:123] = 1
_KIND[ord("'")] = 3
_KIND[[10, 32]] = 0


class ChunkEncoder:
    """Whole-text encoding by cached chunks.

    The tokenizer lowers case, its pre-tokens never hold a blank, and one ends wherever a letter meets
    a digit or mark (an apostrophe aside, which may start a contraction). So a text's ids are those of
    the stretches between such places in turn. Arrow numbers the distinct ones of a slice; those not
    seen before go to the library, and ids are gathered by numbers. A slice that may hold the name of a
    special token is cut at blanks alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(tokens.values(), default=0) + 1, bool)
        self.ends[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.chunks = ChunkIds(self._learn, CACHE_BYTES)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        parts = (texts[a : a + 10_000] for a in range(0, len(texts), 10_000))
        return [e.ids for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of a-z are one pre-token each, whose last id tells its end: they go together."""
        words = [c for c in chunks if c.isascii() and c.isalpha() and c.islower()]
        ids, _ = flat(self._encoded([" ".join(words[a : a + 500]) for a in range(0, len(words), 500)]))
        n = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(n) != len(words):  # not such a tokenizer
            return flat(self._encoded(chunks))
        if len(words) == len(chunks):
            return ids, n
        # the others one by one, each in its place
        other, m = flat(self._encoded([c for c in chunks if not (c.isascii() and c.isalpha() and c.islower())]))
        is_word = np.array([c.isascii() and c.isalpha() and c.islower() for c in chunks])
        length = np.empty(len(chunks), np.int64)
        length[is_word], length[~is_word] = n, m
        out, own = np.empty(int(length.sum()), np.uint32), np.repeat(is_word, length)
        out[own], out[~own] = ids, other
        return out, length

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has; nulls count as empty."""
        plain = Texts(texts)
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        data = plain.bytes if special else LOWER[plain.bytes]
        kind = _KIND[data]
        inside = kind > 0
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = (kind[:-1] == 0) | (not special) & ((kind[:-1] == 1) & (kind[1:] == 2) | (kind[:-1] == 2) & (kind[1:] == 1))
        start[plain.offsets] = True
        at = np.append(np.flatnonzero(start[:-1][inside]), inside.sum())
        cut = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside])))
        numbered = cut.dictionary_encode()
        ids, n = self.chunks.gather(numbered.dictionary.to_pylist(), numbered.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(inside)])[plain.offsets]
        return ids, counts_of(n, np.searchsorted(at, ends))


@cache
def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder a Python worker: the tasks that a worker runs in turn share what is remembered."""
    return ChunkEncoder(path)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, bits: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write one file a range partition, in ascending id order.

    Returns the written files, ``(part, path, n_docs, n_ids)``. Null texts count as empty: the end id
    alone. Rows of equal id follow each other, by text. An empty table gives no documents.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, path = chunk_encoder(tokenizer_path), None, None
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                if writer is None:
                    out, path = create(folder, f"part-{TaskContext.get().partitionId():06d}")
                    writer = PlaneWriter(out, bits)
                ids, counts = encoder.encode(part.column(1))
                writer.add(part.column(0).to_numpy(), counts + 1, np.insert(ids, np.cumsum(counts), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [path], "n_docs": pa.array([writer.n_docs], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    ordered = source.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read back from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with open_file(path) as source:
                    for doc_id, n, pieces in PlaneReader(source).documents():
                        crc = 0
                        for piece in pieces:
                            crc = zlib.crc32(piece, crc)
                        rows.append((doc_id, base, n, crc))
                        base += n
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a file: the running sum over files is small, whatever the number of documents
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = files.withColumn("base", before).select("path", "base", "part")
    return placed.repartition(n, "part").select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_planes(docs: DataFrame, tokenizer_path: str, end_id: int = 1, bits: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids, read the files back: ``(doc_id, start, n_tokens, ids_crc32)``.

    Rows without an id are left out, as they have no place in the order.
    """
    folder = new_folder(docs.sparkSession, "planes")
    return read_token_files(write_token_files(docs, tokenizer_path, end_id, folder, bits, id_col, text_col))
